"""Secret scan: patterns find candidates, ownership over the whole corpus tells what they are.

A value that many owners hold is an example copied from a manual; one that a single owner
holds, and that looks random, is likely a working credential.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import pick, stored

# Fixed values of the contract: the patterns and the least lengths of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
LEAST_VALUE = 12
# A run that is long enough is found by asking for the length at once: shorter runs hold no other match.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "live")

# Candidates without a keyword: long runs of token characters that mix cases and digits.
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
# Texts that none of the patterns can match are told by one pass of a finite automaton.
ANY = r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}|(?i:passw|secret|token|api_?key)|[A-Za-z0-9+/_-]{20}"

# A value with this many different characters, letters and digits, and none of these words, looks live.
LEAST_DIFFERENT = 8
PLACEHOLDERS = ("example", "changeme", "placeholder", "your", "sample", "dummy", "xxxx", "0123456789", "abcdef012345")
# Held by this many owners, a value is a copied example.
WIDELY = 3
SALTS = 32


def looks_live(value: str) -> bool:
    low = value.lower()
    return (
        len(set(value)) >= LEAST_DIFFERENT
        and any(c.isdigit() for c in value)
        and any(c.isalpha() for c in value)
        and not any(word in low for word in PLACEHOLDERS)
    )


def scan_text(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the pattern matches, and (start, end) of the values that may be credentials."""
    spans, values = [], set()
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST_VALUE:
            spans.append(("assign", m.start(), m.end()))
            values.add((m.start(2), m.start(2) + len(m[2].rstrip("."))))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            spans.append((kind, *m.span()))
            values.add(m.span())
    for m in OPAQUE.finditer(text):
        if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]):
            values.add(m.span())
    return spans, sorted(values)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
VALUE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("told", pa.binary()), ("looks_live", pa.bool_())])
FOUND_DDL = (
    "row long, doc_id long, owner string, repository string, spans array<struct<kind: string, start: long, end: long>>, "
    "candidates array<struct<start: long, end: long, told: binary, looks_live: boolean>>"
)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the column ``text``, the last, by its spans and candidates."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.large_string())
        spans, values = [[]] * len(texts), [[]] * len(texts)
        for i in pc.indices_nonzero(pc.match_substring_regex(texts, ANY)).to_pylist():
            text = texts[i].as_py()
            found, held = scan_text(text)
            spans[i] = [{"kind": k, "start": s, "end": e} for k, s, e in found]
            values[i] = [
                {"start": s, "end": e, "told": hashlib.sha256(text[s:e].encode()).digest(), "looks_live": looks_live(text[s:e])}
                for s, e in held
            ]
        columns = [*batch.columns[:-1], pa.array(spans, pa.list_(SPAN)), pa.array(values, pa.list_(VALUE))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "spans", "candidates"])


def ownership(found: DataFrame) -> DataFrame:
    """told, owners, repositories, occurrences for every candidate value of the corpus.

    Counted by value, owner and repository first, so that a value with a third of all
    occurrences moves one row per task, owner and repository.
    """
    held = found.select("owner", "repository", F.explode("candidates.told").alias("told"))
    by_repository = held.groupBy("told", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("told", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("told").agg(
        F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("occurrences")
    )


def joined_spans(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = {kind: i for i, kind in enumerate(KINDS)}
    ranks = F.create_map(*(F.lit(x) for pair in rank.items() for x in pair))
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"], ranks[s["kind"]].alias("rank"), s["end"], s["kind"]))
    )
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def find_secrets(docs: DataFrame, owner: Column, repository: Column, widely: int = WIDELY) -> DataFrame:
    """Spans that look like secrets in every whole text, and which of their values are live-looking.

    Needs ``doc_id`` and ``text``; ``owner`` and ``repository`` are expressions over the
    columns of ``docs``. Returns one row per row: doc_id, n_assign, n_access, n_hex,
    base_sha256 (digest of the spans of these kinds), spans (with the kind ``live`` added),
    n_live, n_copied (values that ``widely`` or more owners hold).

    1. Each text is scanned once. Candidates are the values of assignments, access keys,
       runs of hexadecimal digits, and long runs that mix cases and digits; of a value only the
       digest leaves the task.
    2. :func:`ownership` counts owners and repositories of each digest over the corpus.
    3. A value of fewer than ``widely`` owners that looks random is ``live``; others stay
       candidates of the base kinds. Values are looked up with a salt, as one of them may be in a third of all texts.

    Null and empty texts have no spans. A null owner or repository is one of its own.
    Rows with equal ids are scanned one by one. Columns of other names are ignored. A very long
    text is held once, in the task that scans it. An empty table gives no rows.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        owner.cast("string").alias("owner"),
        repository.cast("string").alias("repository"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    found = stored(rows.mapInArrow(_scanned, FOUND_DDL), "secret-candidates")
    held = found.where(F.size("candidates") > 0)
    counts = ownership(held).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    values = held.select("row", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"), F.inline("candidates"))
    live = F.when((F.col("owners") < widely) & F.col("looks_live"), F.struct(F.lit("live").alias("kind"), "start", "end"))
    judged = (
        values.join(counts, ["told", "salt"])
        .groupBy("row")
        .agg(F.collect_list(live).alias("live"), F.count_if(F.col("owners") >= widely).alias("copied"))
        .withColumnRenamed("row", "of")
    )
    return found.join(judged, F.col("row") == F.col("of"), "left").select(
        "doc_id",
        *(F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined_spans(F.col("spans")), 256).alias("base_sha256"),
        joined_spans(F.concat("spans", F.coalesce("live", F.array().cast("array<struct<kind:string,start:long,end:long>>")))).alias("spans"),
        F.coalesce(F.size("live"), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("copied", F.lit(0)).alias("n_copied"),
    )


def scan_documents(docs: DataFrame, widely: int = WIDELY) -> DataFrame:
    """:func:`find_secrets` for a corpus: a source owns its texts, those of one language are a repository."""
    rows = pick(docs, doc_id="long", text="string", source="string", lang="string")
    return find_secrets(rows, F.col("source"), F.col("lang"), widely)
