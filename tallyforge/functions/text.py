"""Text functions: normal forms, hashes, chunks and HTML."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Endings of names that are left out.
SUFFIXES = ("jr", "junior", "snr", "senior", "ii", "iii")

#: Texts that a task of ``simhash60`` hashes at once, and features that it turns into bits at once.
TEXTS, STEP = 1024, 65_536


def content_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with runs of white space as one space."""
    return F.sha2(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


@F.pandas_udf(StringType())
def strip_accents(names: pd.Series) -> pd.Series:
    import unicodedata

    return names.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


def normal_name(plain: Column) -> Column:
    """Lower case letters and digits of a name without accents: no apostrophes, hyphens as spaces, no suffixes."""
    cleaned = F.regexp_replace(F.translate(F.lower(plain), "-'", " "), "[^a-z0-9 ]+", " ")
    return F.array_join(F.filter(F.split(F.trim(cleaned), " +"), lambda w: (w != "") & ~w.isin(*SUFFIXES)), " ")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _heads(features: Iterator[str]) -> np.ndarray:
    """The first eight bytes of each feature's MD5."""
    heads = b"".join(hashlib.md5(f.encode(), usedforsecurity=False).digest()[:8] for f in features)
    return np.frombuffer(heads, np.uint8).reshape(-1, 8)


def _bit_counts(heads: np.ndarray, of: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """For each of n owners how many of its features have each of the 60 bits; ``of`` are places in heads, ``owners`` ascend."""
    counts = np.zeros((n, 60), np.int64)
    for low in range(0, len(of), STEP):
        mine = owners[low : low + STEP]
        starts = np.flatnonzero(np.diff(mine, prepend=-1))
        bits = np.unpackbits(heads[of[low : low + STEP]], axis=1)[:, 59::-1]
        counts[mine[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    return counts


def _feature_sums(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """For each text's words 60 sums over its features: their weights, negative where the feature's hash has no such bit.

    Each distinct feature of some texts is hashed once.
    """
    for whole in batches:
        for batch in (whole.slice(i, TEXTS) for i in range(0, whole.num_rows, TEXTS)):
            n, lists = batch.num_rows, batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            owners, coded = np.repeat(np.arange(n), lengths), lists.flatten().dictionary_encode()
            of, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            inside = owners[1:] == owners[:-1]
            codes, pairs = np.unique((of[:-1] * len(vocabulary) + of[1:])[inside], return_inverse=True)
            named = (f"{vocabulary[a]}_{vocabulary[b]}" for a, b in zip(*(x.tolist() for x in np.divmod(codes, len(vocabulary))), strict=True))
            sums = 4 * _bit_counts(_heads(vocabulary), of, owners, n) + 2 * _bit_counts(_heads(named), pairs, owners[1:][inside], n)
            sums -= (3 * lengths - 1)[:, None]
            out = pa.record_batch([batch.column(0), *map(pa.array, sums.T)], names=[key, *(f"s{b}" for b in range(60))])
            # texts without a word have no hash
            yield out.filter(pa.array(lengths > 0))


def simhash60(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h): 60-bit SimHash of words (weight 2) and pairs of neighbours (weight 1), over the head of each one's MD5.

    A text's features are counted and hashed where the text lies; only its 60 sums are shuffled, so that rows which share a key add up.
    """
    split = docs.select(key, words(F.col(text)).alias("w"))
    schema = StructType([split.schema[key], *(StructField(f"s{b}", LongType()) for b in range(60))])
    each = split.mapInArrow(partial(_feature_sums, key=key), schema)
    sums = each.groupBy(key).agg(*(F.sum(f"s{b}").alias(f"s{b}") for b in range(60)))
    total = F.lit(0).cast("long")
    for b in range(60):
        total = total + F.when(F.col(f"s{b}") > 0, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long"))
    return sums.select(key, total.alias("h"))


def chunks(docs: DataFrame, key: str, text: str, size: int = 550, stride: int = 490) -> DataFrame:
    """(key, chunk, text): overlapping runs of words; the last may hold only words of the one before."""
    split = docs.select(key, F.split(F.trim(text), r"\s+").alias("w")).withColumn("n", F.size("w"))
    at = split.select(key, "w", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(stride))).alias("chunk", "start"))
    return at.select(key, "chunk", F.array_join(F.slice("w", F.col("start") + 1, size), " ").alias("text"))


class _Text(HTMLParser):
    SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}

    def __init__(self) -> None:
        super().__init__()
        self.skip, self.inside, self.paragraphs, self.part = 0, False, [], []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIPPED
        if tag == "p":
            self.close_paragraph()
            self.inside = True

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIPPED))
        if tag == "p":
            self.close_paragraph()

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.part.append(data)

    def close_paragraph(self):
        text = " ".join("".join(self.part).split())
        if len(text) > 40:
            self.paragraphs.append(text)
        self.part, self.inside = [], False


def _paragraphs(html: str | None) -> str | None:
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close_paragraph()
    return "\n\n".join(parser.paragraphs)


@F.pandas_udf(StringType())
def html_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Paragraphs of more than 40 characters outside scripts, styles and page furniture."""
    for page in pages:
        yield page.map(_paragraphs)


def parse_duration(c: Column) -> Column:
    """Seconds of an ISO-8601 duration such as PT1H2M3S."""
    part = lambda unit: F.coalesce(F.regexp_extract(c, rf"(\d+){unit}", 1).try_cast("long"), F.lit(0))
    return part("H") * 3600 + part("M") * 60 + part("S")


def lenient_int(c: Column) -> Column:
    return c.try_cast("double").try_cast("int")


def iso_timestamp(c: Column) -> Column:
    """The instant of an ISO text in UTC; without an offset it is in UTC, and what can't be read is null."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def season_start(season: Column) -> Column:
    """2026 of "2026-27"; null if it isn't written so."""
    return F.when(season.rlike(r"^\d{4}-\d{2}$"), F.split_part(season, F.lit("-"), F.lit(1)).try_cast("int"))


def season_name(year: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), F.lpad((year + 1 - F.floor((year + 1) / 100) * 100).cast("int").cast("string"), 2, "0"))


def money(c: Column) -> Column:
    """Whole units of a price such as €1.2m or £300k; null if there is none."""
    number = F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)\s*([mk]?)", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)\s*([mkMK]?)", 2))
    return F.round(number * F.when(unit == "m", 1_000_000).when(unit == "k", 1_000).otherwise(1)).cast("long")


def name_variants(first: Column, last: Column, web: Column, full: Column) -> Column:
    """The distinct normal forms under which a name may be found, sorted; nulls and empty ones are left out."""
    both = F.concat_ws(" ", first, last)
    initial = F.when((F.length(first) > 0) & (F.length(last) > 0), F.concat_ws(" ", F.substring(first, 1, 1), last))
    forms = F.array(*(normal_name(c) for c in (full, web, last, both, initial)))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: x.isNotNull() & (x != ""))))


#: Keys that change on every fetch without the content meaning anything else.
VOLATILE = ("now", "timestamp", "fetched_at", "request_id", "requestId", "server_time", "last_updated", "lastUpdated", "generated_at", "etag", "cache_key", "ts")


def _lasting(pairs: list[tuple[str, object]]) -> dict[str, object]:
    """What the parser makes of a JSON object: its pairs without the volatile ones."""
    return {key: value for key, value in pairs if key not in VOLATILE}


@F.pandas_udf(StringType())
def canonical_json(payloads: pd.Series) -> pd.Series:
    """JSON objects and arrays with sorted keys and without volatile ones, at any depth; null for all else, such as what nests
    deeper than the parser goes. Volatile pairs go while the parser closes each object, so that nothing walks the result again."""
    read, write = json.JSONDecoder(object_pairs_hook=_lasting), json.JSONEncoder(sort_keys=True, separators=(",", ":"))

    def canonical(payload: str | None) -> str | None:
        # only what starts as an object or an array is worth parsing
        if payload is None or payload.lstrip()[:1] not in ("{", "["):
            return None
        try:
            return write.encode(read.decode(payload))
        except (ValueError, RecursionError):
            return None

    return payloads.map(canonical)


def payload_hash(payload: Column) -> Column:
    """SHA-256 of what a payload says: of its canonical JSON, or of its text as in ``content_hash``."""
    canonical = canonical_json(payload)
    return F.when(canonical.isNotNull(), F.sha2(canonical, 256)).otherwise(content_hash(payload))


def deep_link(url: Column, seconds: Column) -> Column:
    """A link to a place in a video, in whole seconds."""
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&t=").otherwise("?t="), F.floor(seconds).cast("long").cast("string"), F.lit("s"))


def int_range(c: Column) -> tuple[Column, Column]:
    """Both ends of "3-7"; a single number is both, and what can't be read is null."""
    low, high = (F.trim(F.split_part(c, F.lit("-"), F.lit(i))).try_cast("int") for i in (1, 2))
    single = ~F.contains(c, F.lit("-"))
    return F.when(single | high.isNotNull(), low), F.when(single, low).otherwise(F.when(low.isNotNull(), high))


def salvaged_json(text: Column) -> Column:
    """The JSON of a talkative answer: what a fence holds, else from the first brace to the last; null if it can't be parsed."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).otherwise(F.when(braces != "", braces))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def field_kind(c: Column) -> Column:
    """What a setting written as text holds: boolean, integer, number, list, object or text."""
    return F.when(c.rlike("^(true|false)$"), "boolean").when(c.rlike("^-?[0-9]+$"), "integer").when(c.rlike(r"^-?[0-9]*\.[0-9]+$"), "number").when(c.rlike(r"^\["), "list").when(c.rlike(r"^\{"), "object").otherwise("text")


def redacted(name: Column, value: Column) -> Column:
    """The value of a setting, masked where its name says that it is a secret."""
    return F.when(F.lower(name).rlike("(key|token|secret|password|cookie)"), F.when(F.coalesce(value, F.lit("")) != "", "***").otherwise("")).otherwise(value)


def mail_timestamp(c: Column) -> Column:
    """The instant of "Mon, 01 Jan 2024 10:00:00 +0000", as feeds write it, or of "Mon Jan 01 10:00:00 +0000 2024"; else null."""
    plain = F.regexp_replace(c, r"^[A-Za-z]{3},? +", "")
    return F.coalesce(*(F.try_to_timestamp(plain, F.lit(f)) for f in ("dd MMM yyyy HH:mm:ss Z", "MMM dd HH:mm:ss Z yyyy")))


def swap(c: Column) -> tuple[Column, Column]:
    """(out, in) of a swap written as "a -> b", "a → b", "a to b" or "b for a"; nulls for anything else."""
    arrow = r"^(.+?)\s*(?:->|→| to )\s*(.+)$"
    other = r"^(.+?) for (.+)$"
    part = lambda p, i: F.when(c.rlike(p), F.trim(F.regexp_extract(c, p, i)))
    return F.coalesce(part(arrow, 1), part(other, 2)), F.coalesce(part(arrow, 2), part(other, 1))
