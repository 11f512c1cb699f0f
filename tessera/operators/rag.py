"""Context and prompts from retrieved chunks, and a client interface for answers."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed texts of the prompt and of answers without a model.
SOURCE_LINE = "[资料%d | %s | chunk %d]\n%s"
PROMPT = "问题：%s\n\n本地资料：\n%s\n\n请给出简洁回答并引用资料编号。"
SYSTEM = "你是证券本地知识库助手。只依据用户提供的本地资料回答；资料不足时明确说明，不得编造。回答应简洁，并引用资料编号。"
NO_MODEL = "模型接口未配置。检索已经完成并返回下方本地 Context。"
MOCK_WARNING = "Mock Embedding 仅用于工程链路验证，不代表真实检索质量。"
EFFORTS = ("low", "high", "max")


def contexts(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """key, context, n_sources, from ``hits`` (key, rank, file_name, chunk_index, text) in the order of ranks."""
    source = F.format_string(SOURCE_LINE, F.col("rank").cast("int"), F.col("file_name"), F.col("chunk_index").cast("int"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", source.alias("line"))))  # a query's k hits
    return hits.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("context"), F.count(F.lit(1)).alias("n_sources"))


def prompt(question: Column, context: Column) -> Column:
    return F.format_string(PROMPT, question, context)


def context_evidence(chunks: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` chunks joined by blank lines: context, sha256 and length in characters."""
    first = chunks.orderBy(*order).limit(n).select(F.struct(*order, "text").alias("c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x["text"]), "\n\n")
    return first.agg(text.alias("context")).select("context", F.sha2("context", 256).alias("sha256"), F.length("context").alias("n_chars"))


class LlmClient(Protocol):
    def complete(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class LlmConfig:
    """Where and how an answer is asked for; https, or a loopback address."""

    base_url: str
    api_key: str
    model: str
    reasoning_effort: str = "high"
    thinking: bool = False
    timeout: float = 60.0

    def __post_init__(self):
        url = urlparse(self.base_url)
        if url.scheme != "https" and url.hostname not in ("localhost", "127.0.0.1", "::1"):
            raise ValueError("base_url has to be https or loopback")
        if self.reasoning_effort not in EFFORTS:
            raise ValueError(f"reasoning_effort is one of {EFFORTS}")
        if not self.api_key.strip() or not self.model.strip():
            raise ValueError("api_key and model are needed")

    def body(self, text: str, system: str = SYSTEM) -> dict:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": text}]
        out = {"model": self.model, "messages": messages, "stream": False, "thinking": {"type": "enabled" if self.thinking else "disabled"}}
        return out | ({"reasoning_effort": self.reasoning_effort} if self.thinking else {})


def answer_text(response: dict) -> str:
    """The answer in a chat completion; ValueError if there is none."""
    choices = response.get("choices") or [{}]
    content = (choices[0].get("message") or {}).get("content")
    if not content:
        raise ValueError("the response holds no answer")
    return content


def _replies(client: LlmClient, tries: int, at_once: int, pause: float):
    """A column function from prompts to structs of answer and error; a prompt that fails ``tries`` times has an error."""

    def ask(text: str) -> tuple[str | None, str | None]:
        error = None
        for n in range(tries):
            if n:
                time.sleep(pause * 2 ** (n - 1))
            try:
                return client.complete(text), None
            except Exception as failed:  # whatever a client raises becomes the row's error
                error = f"{type(failed).__name__}: {failed}"
        return None, error

    def run(texts: pd.Series) -> pd.DataFrame:
        with ThreadPoolExecutor(at_once) as pool:
            return pd.DataFrame(list(pool.map(ask, texts)), columns=["answer", "error"])

    return F.pandas_udf(run, "answer string, error string").asNondeterministic()


def answers(questions: DataFrame, hits: DataFrame, client: LlmClient | None = None, mock: bool = False, tries: int = 2, at_once: int = 8, calls: int = 64, pause: float = 0.5) -> DataFrame:
    """query_id, question, prompt, answer, error, llm_used, warning for ``questions`` (query_id, text).

    With a client, which has to be picklable, prompts are answered in tasks, ``at_once`` in each and ``calls`` in all at a
    time, however many cores there are. A prompt without an answer after ``tries`` calls, with a pause that doubles between
    them, has a null answer and the last error.
    """
    if tries < 1 or at_once < 1 or calls < 1:
        raise ValueError("tries, at_once and calls have to be positive")
    rows = questions.join(contexts(hits), "query_id", "left")
    asked = rows.select("query_id", F.col("text").alias("question"), prompt(F.col("text"), F.coalesce("context", F.lit(""))).alias("prompt"))
    if client is None:
        replied = asked.withColumns({"answer": F.lit(NO_MODEL), "error": F.lit(None).cast("string")})
    else:
        at_once = min(at_once, calls)
        replied = asked.repartition(calls // at_once).withColumn("_reply", _replies(client, tries, at_once, pause)("prompt")).select("*", "_reply.answer", "_reply.error").drop("_reply")
    return replied.withColumns({"llm_used": F.lit(client is not None), "warning": F.lit(MOCK_WARNING if mock else None).cast("string")})
