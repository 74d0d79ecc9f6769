"""Outside services behind small protocols: search for phrases, grammar, language models.

None is called unless one is given. `fetch` and `post` do the transport and are given by the caller,
so nothing here opens a connection of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.config import EngineConfig

MATCHES = "array<struct<url:string,title:string,snippet:string>>"


class ServiceError(RuntimeError):
    """An outside service couldn't be reached, or refused."""


class SearchProvider(Protocol):
    name: str

    def search(self, phrase: str) -> list[dict]:
        """Matches with url, title and snippet."""


class NoSearch:
    name = "none"

    def search(self, phrase: str) -> list[dict]:
        return []


class JsonSearch:
    """A service that answers with JSON `items` of link, title, snippet. fetch(url, params) -> dict."""

    name = "json"

    def __init__(self, url: str, fetch, **params: str):
        self.url, self.fetch, self.params = url, fetch, params

    def search(self, phrase: str) -> list[dict]:
        found = self.fetch(self.url, self.params | {"exactTerms": phrase})
        return [{"url": x.get("link", ""), "title": x.get("title", ""), "snippet": x.get("snippet", "")} for x in found.get("items", [])]


class XmlSearch:
    """A service that answers with XML `doc` elements of url, title and passage. fetch -> str.

    Texts are taken as written, markup inside removed, entities left. Entries without a url are
    passed over; without a title the url stands for it.
    """

    name = "xml"

    def __init__(self, url: str, fetch, **params: str):
        self.url, self.fetch, self.params = url, fetch, params

    @staticmethod
    def inside(xml: str, name: str) -> str | None:
        """What stands in the first element of the name, markup removed."""
        _, opened, rest = xml.partition(f"<{name}>")
        value, closed, _ = rest.partition(f"</{name}>")
        if not (opened and closed):
            return None
        return "".join(part.rpartition(">")[2] if i and ">" in part else part for i, part in enumerate(value.strip().split("<"))).strip()

    def search(self, phrase: str) -> list[dict]:
        xml = self.fetch(self.url, self.params | {"query": f'"{phrase}"'})
        blocks = [b.partition("</doc>")[0] for b in xml.split("<doc>")[1:] if "</doc>" in b]
        found = []
        for b in blocks:
            url, title, passage = (self.inside(b, n) for n in ("url", "title", "passage"))
            if url:
                found.append({"url": url, "title": url if title is None else title, "snippet": passage or ""})
        return found


def external_search(sample: DataFrame, provider: SearchProvider | None, config: EngineConfig = EngineConfig(), docs: DataFrame | None = None) -> DataFrame:
    """doc_id, enabled, provider, queried_phrases, results; sample: doc_id, phrase.

    Every document of `docs` (or else of the sample) has a row. A phrase whose search failed is
    counted and has no result; one without matches has an empty list.
    """
    provider = provider or NoSearch()
    result = f"array<struct<phrase:string,matches:{MATCHES}>>"
    each = (sample if docs is None else docs).select("doc_id").distinct()
    if not config.external_search:
        return each.select("doc_id", F.lit(False).alias("enabled"), F.lit(provider.name).alias("provider"), F.lit(0).cast("long").alias("queried_phrases"), F.array().cast(result).alias("results"))

    def ask(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(phrase: str):
            try:
                return provider.search(phrase)
            except Exception:  # noqa: BLE001 - a service may fail in any way
                return None

        kind = pa.list_(pa.struct([("url", pa.string()), ("title", pa.string()), ("snippet", pa.string())]))
        for f in frames:
            yield pa.record_batch([f.column("doc_id"), f.column("phrase"), pa.array([one(p) for p in f.column("phrase").to_pylist()], kind)], names=["doc_id", "phrase", "matches"])

    asked = sample.select("doc_id", "phrase")
    found = asked.mapInArrow(ask, asked.select("doc_id").schema.add("phrase", "string").add("matches", _match_type()))
    per = found.groupBy("doc_id").agg(F.count("*").alias("queried_phrases"), F.sort_array(F.collect_list(F.when(F.col("matches").isNotNull(), F.struct("phrase", "matches")))).alias("results"))  # a sample's size at most
    return each.join(per, "doc_id", "left").select(
        "doc_id", F.lit(True).alias("enabled"), F.lit(provider.name).alias("provider"), F.coalesce("queried_phrases", F.lit(0)).alias("queried_phrases"), F.coalesce("results", F.array().cast(result)).alias("results"))


def _match_type():
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    return ArrayType(StructType([StructField(n, StringType()) for n in ("url", "title", "snippet")]))


class GrammarService:
    """An outside grammar service as a checker for `operators.grammar`.

    post(url, form) -> (status, body as dict). A text for which it raises, or that has a status other
    than 2xx, has one row with the reason as its `error` and nothing else; other texts go on.
    """

    def __init__(self, url: str, post: Callable[[str, dict], tuple[int, dict]], language: str = "auto"):
        self.url, self.post, self.language = url, post, language

    def check(self, text: str) -> list[dict]:
        status, body = self.post(f"{self.url.rstrip('/')}/v2/check", {"language": self.language, "text": text})
        if not 200 <= status < 300:
            raise ServiceError(f"grammar service: status {status}")
        return [{"rule_id": m["rule"]["id"], "category": (m["rule"].get("category") or {}).get("name"), "message": m["message"], "position": m["offset"], "length": m["length"]} for m in body["matches"]]

    def found(self, text: str) -> list[dict]:
        try:
            return self.check(text)
        except Exception as e:  # noqa: BLE001 - a service may fail in any way
            return [{"error": (str(e) or type(e).__name__).splitlines()[0][:500]}]

    def __call__(self, docs: DataFrame) -> DataFrame:
        names = ["rule_id", "category", "message", "position", "length", "error"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for f in frames:
                found = [self.found(t or "") for t in f.column("text").to_pylist()]
                rows = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                yield pa.record_batch([f.column("doc_id").take(rows), *(pa.array([m.get(n) for x in found for m in x], t) for n, t in zip(names, types, strict=True))], names=["doc_id", *names])

        schema = docs.select("doc_id").schema
        for n, kind in zip(names, ("string", "string", "string", "long", "long", "string"), strict=True):
            schema = schema.add(n, kind)
        return docs.select("doc_id", "text").mapInArrow(run, schema)


class LanguageService:
    """An outside service for sentence vectors, lemmas, perplexity and OCR.

    post(path, payload) -> (status, body). Status 503 says that a feature is off: None. Transport
    errors become ServiceError.
    """

    def __init__(self, post: Callable[[str, dict], tuple[int, dict]]):
        self.post = post

    def ask(self, path: str, payload: dict) -> dict | None:
        try:
            status, body = self.post(path, payload)
        except OSError as e:
            raise ServiceError("language service: unavailable") from e
        if status == 503:
            return None
        if not 200 <= status < 300:
            raise ServiceError(f"language service: status {status}")
        return body

    def perplexity(self, text: Column) -> Column:
        """A text's perplexity, null where the feature is off; a model for `ai.perplexity_scorer`."""

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for p in parts:
                found = [self.ask("perplexity", {"text": t or ""}) for t in p]
                yield pd.Series([None if x is None else x["perplexity"] for x in found], dtype=float)

        return run(text)

    def embedding(self, sentence: Column) -> Column:
        """Sentence vectors, asked for batch by batch; an embedder for `semantic.sentence_vectors`."""

        @F.pandas_udf("array<float>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for p in parts:
                found = self.ask("embed-sentences", {"sentences": p.tolist()})
                yield pd.Series([None] * len(p) if found is None else found["embeddings"], dtype=object)

        return run(sentence)

    def lemmas(self, words: Column) -> Column:
        """(lemma, pos) of each word; an analyser for `metrics.lemmas`."""

        @F.pandas_udf("array<struct<lemma:string,pos:string>>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for p in parts:
                found = [self.ask("lemmatize", {"text": " ".join(w)}) for w in p]
                yield pd.Series([None if x is None else [{"lemma": t["lemma"], "pos": t["pos"]} for t in x["tokens"]] for x in found], dtype=object)

        return run(words)

    def ocr(self, content: Column) -> Column:
        """Texts of a file's pages, null where the feature is off or fails; for `files.extract`."""

        @F.pandas_udf("array<string>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def one(data):
                try:
                    found = None if data is None else self.ask("ocr", {"content": base64.b64encode(data).decode()})
                except ServiceError:
                    return None
                return None if found is None else found["pages"]

            for p in parts:
                yield pd.Series([one(x) for x in p], dtype=object)

        return run(content)
