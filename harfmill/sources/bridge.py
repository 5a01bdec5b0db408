"""An external morphology as a line protocol: one JSON request a line, one JSON answer a line.

`analyse_words` runs one backend process per Spark partition and sends it
batches of words; a backend that dies fails the task, which Spark retries.
`python -m harfmill.sources.bridge` is a backend itself, with the rule analyser.
"""

from __future__ import annotations

import json
import re
import subprocess
import sys
from collections.abc import Iterator
from typing import Any, TextIO

import pandas as pd
from pyspark.sql import DataFrame

from harfmill.functions.arabic import LETTERS, LONG_VOWELS, MARKS
from harfmill.functions.morphology import SEGMENTS

BATCH = 256


class Backend:
    """A process that answers requests; closed at the end of the partition."""

    def __init__(self, command: list[str]) -> None:
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, encoding="utf-8")

    def ask(self, op: str, **fields: Any) -> Any:
        self.process.stdin.write(json.dumps({"op": op, **fields}, ensure_ascii=False) + "\n")
        self.process.stdin.flush()
        line = self.process.stdout.readline()
        if not line:
            raise RuntimeError(f"the backend ended with code {self.process.wait()}")
        answer = json.loads(line)
        if not answer.get("ok"):
            raise RuntimeError(answer.get("error", "the backend refused"))
        return answer["result"]

    def close(self) -> None:
        if self.process.poll() is None:
            self.process.stdin.write('{"op": "shutdown"}\n')
            self.process.stdin.close()
            self.process.wait(10)


def analyse_words(words: DataFrame, command: list[str]) -> DataFrame:
    """words: word, distinct.  (word, root, stem), null where the backend has no analysis."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = Backend(command)
        try:
            for part in parts:
                for lo in range(0, len(part), BATCH):
                    some = part["word"].iloc[lo : lo + BATCH].tolist()
                    yield pd.DataFrame([(w, a and a["root"], a and a["stem"]) for w, a in zip(some, backend.ask("analyze", words=some), strict=True)], columns=["word", "root", "stem"])
        finally:
            backend.close()

    return words.select("word").mapInPandas(run, "word string, root string, stem string")


def analyse(word: str) -> dict[str, str] | None:
    """The rule analysis of one word."""
    bare = re.sub(f"[{MARKS}]", "", word)
    m = re.match(SEGMENTS, bare, re.S)
    stem = m[4] if m else bare
    consonants = re.sub(f"[{LONG_VOWELS}]|[^{LETTERS}]", "", stem)
    if len(consonants) < 3:
        return None
    return {"root": consonants if len(consonants) <= 4 else consonants[:3], "stem": stem}


def generate(root: str, pattern: str) -> str:
    """A pattern with digits filled by the root's letters."""
    return "".join((root[int(ch) - 1] if int(ch) <= len(root) else "") if ch in "1234" else ch for ch in pattern)


def serve(source: TextIO, out: TextIO) -> None:
    """Answer until shutdown; a bad line or an unknown op is an answer too."""
    for line in source:
        try:
            request = json.loads(line)
            op = request.get("op")
            if op == "shutdown":
                return
            if op == "analyze":
                answer = {"ok": True, "result": [analyse(w) for w in request["words"]]}
            elif op == "generate":
                answer = {"ok": True, "result": generate(request["root"], request["pattern"])}
            else:
                answer = {"ok": False, "error": f"unknown op {op!r}"}
        except Exception as error:  # the loop outlives any request
            answer = {"ok": False, "error": str(error)}
        out.write(json.dumps(answer, ensure_ascii=False) + "\n")
        out.flush()


if __name__ == "__main__":
    serve(sys.stdin, sys.stdout)
