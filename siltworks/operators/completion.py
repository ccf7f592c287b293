"""Text generation around a pluggable completer: prompts, chat windows, recovery of JSON from answers."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Completer = Callable[[str], str]


def offline(prompt: str) -> str:
    """The default completer: deterministic, no network. Answers with the prompt's length and first words as JSON."""
    return json.dumps({"chars": len(prompt), "about": " ".join(prompt.split()[:8])})


SYSTEM = "You document source code. Keep to what the given material shows."


@dataclass(frozen=True)
class Client:
    """A completer that posts to a chat endpoint. model is named as the provider knows it (sources.project.endpoint).

    ask() also gives the usage that the provider counts. Errors are raised with the status and without the key.
    """

    address: str
    model: str
    api_key: str = ""
    temperature: float = 0.3
    max_tokens: int = 4096
    timeout: float = 120.0
    system: str = SYSTEM

    def messages(self, prompt: str) -> list[dict]:
        return [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]

    def _post(self, prompt: str, **more):
        body = {"model": self.model, "messages": self.messages(prompt), "temperature": self.temperature, "max_tokens": self.max_tokens, **more}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        try:
            return urllib.request.urlopen(urllib.request.Request(self.address, json.dumps(body).encode(), headers), timeout=self.timeout)  # noqa: S310
        except urllib.error.HTTPError as e:
            raise RuntimeError(f"{e.code}: {e.read().decode(errors='replace')}") from None

    def ask(self, prompt: str) -> tuple[str, dict]:
        """(text, usage) of one answer."""
        with self._post(prompt) as answer:
            told = json.loads(answer.read())
        said = (told.get("choices") or [{}])[0].get("message") or {}
        return said.get("content") or "", told.get("usage") or {}

    def __call__(self, prompt: str) -> str:
        return self.ask(prompt)[0]

    def stream(self, prompt: str) -> Iterator[str]:
        """The pieces of an answer as they come: lines that begin with "data:" hold JSON, [DONE] ends."""
        with self._post(prompt, stream=True) as answer:
            for line in answer:
                told = line.decode().strip()
                if not told.startswith("data:"):
                    continue
                if (body := told[5:].strip()) == "[DONE]":
                    return
                try:
                    piece = json.loads(body)["choices"][0]["delta"].get("content")
                except (ValueError, LookupError):
                    continue
                if piece:
                    yield piece


def of_config(config) -> Completer:
    """The completer that a project's configuration names: offline, or a client of its provider."""
    if config.model == "offline":
        return offline
    from siltworks.sources.project import endpoint

    address, model = endpoint(config.model, config.api_key, config.api_base)
    return Client(address, model, config.api_key)


#: Status codes after which a call is worth repeating.
PASSING = ("429", "500", "502", "503", "504")
ASKED = "key string, answer string, prompt_tokens long, completion_tokens long, calls int, error string"


class Pace:
    """Lets through so many calls a second, with as many saved up at most; None: all of them."""

    def __init__(self, per_second: float | None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.clock, self.sleep = per_second, clock, sleep
        self.saved, self.at = max(1.0, per_second or 0), clock()

    def wait(self) -> None:
        if self.rate is None:
            return
        now = self.clock()
        self.saved, self.at = min(max(1.0, self.rate), self.saved + (now - self.at) * self.rate), now
        if self.saved < 1:
            self.sleep((1 - self.saved) / self.rate)
            self.saved, self.at = 1.0, self.clock()
        self.saved -= 1


def ask(completer: Completer, prompt: str, pace: Pace, attempts: int, back_off: float) -> tuple:
    """(answer, prompt tokens, completion tokens, calls, error) of one prompt. What passes (PASSING) is asked again after a doubling wait."""
    error = None
    for n in range(attempts):
        pace.wait()
        try:
            text, usage = completer.ask(prompt) if hasattr(completer, "ask") else (completer(prompt), {})
            return text, int(usage.get("prompt_tokens") or 0), int(usage.get("completion_tokens") or 0), n + 1, None
        except Exception as e:  # noqa: BLE001  a provider's errors are its own
            error = f"{type(e).__name__}: {e}"
            if not str(e).startswith(PASSING) or n + 1 == attempts:
                return None, 0, 0, n + 1, error
            pace.sleep(back_off * 2**n)
    return None, 0, 0, attempts, error


def asked(prompts: DataFrame, completer: Completer = offline, at_once: int | None = None, per_second: float | None = None, attempts: int = 4, back_off: float = 1.0) -> DataFrame:
    """key, answer of prompts (key, prompt), with the tokens that the provider counted, how often it was called, and the error
    where the answer is null.

    at_once: how many calls run at once at most, as partitions (without it the partitions at hand). per_second: calls a
    second of all partitions together; each gets its share. A task that is repeated calls again.
    """
    prompts = prompts.repartition(at_once) if at_once else prompts
    share = per_second / (at_once or 1) if per_second else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(share)
        for batch in batches:
            rows = [(k, *ask(completer, p or "", pace, attempts, back_off)) for k, p in zip(batch.column("key").to_pylist(), batch.column("prompt").to_pylist(), strict=True)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in ASKED.split(", ")])

    return prompts.select("key", "prompt").mapInArrow(run, ASKED)


def usage(answers: DataFrame, *by: str) -> DataFrame:
    """prompts, calls, tokens and failures of asked() rows, in all or by some columns."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return answers.groupBy(*by).agg(F.count("*").alias("prompts"), total("calls"), total("prompt_tokens"), total("completion_tokens"), F.count("error").alias("failures"))


def complete(prompts: DataFrame, completer: Completer = offline, at_once: int | None = None) -> DataFrame:
    """key, answer of prompts (key, prompt); a completer that fails gives null (asked() tells why). at_once: as in asked()."""
    return asked(prompts, completer, at_once).select("key", "answer")


def recover_json(text: str) -> str | None:
    """The JSON in an answer: all of it (without one fence), else the longest part from a { or [ to its last closer that parses."""
    body = text.strip()
    if m := re.fullmatch(r"```[a-zA-Z]*\n(.*?)\n?```", body, re.DOTALL):
        body = m[1].strip()

    def fine(s: str) -> bool:
        try:
            json.loads(s)
        except ValueError:
            return False
        return True

    if fine(body):
        return body
    best = None
    for opener, closer in (("{", "}"), ("[", "]")):
        end = body.rfind(closer) + 1
        for m in re.finditer(re.escape(opener), body[:end]):
            part = body[m.start() : end]
            if (best is None or len(part) > len(best)) and fine(part):
                best = part
                break  # later starts are shorter
    return best


def with_json(answers: DataFrame) -> DataFrame:
    """answers (key, answer) with json; Python sees only those that don't parse as they are."""
    parsed = answers.withColumn("json", F.when(F.try_parse_json("answer").isNotNull(), F.trim("answer")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column("answer").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("answer"), pa.array([None if a is None else recover_json(a) for a in old], pa.string())], names=["key", "answer", "json"])

    return parsed.where("json is not null").unionByName(parsed.where("json is null").select("key", "answer").mapInArrow(run, "key string, answer string, json string"))


def chat_window(turns: DataFrame, most: int = 12) -> DataFrame:
    """conv_id, turn, role, text: of each conversation's last `most` turns those by user or assistant that aren't blank."""
    last = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= most).drop("_n")
    return recent.where(F.col("role").isin("user", "assistant") & F.col("text").rlike(r"\S"))


LANGUAGES = {"zh": "Chinese", "ja": "Japanese", "ko": "Korean"}


def prompt(task: str, body: str, language: str = "en") -> str:
    return f"{task}\nAnswer in {LANGUAGES.get(language, 'English')}, as JSON only.\n\n{body}"
