"""WARC archives: writing pages with revisits, and reading back by boundary-chain verification.

Writing. Pages of equal payload are found by its SHA-1 and size; the one of the largest page id
is written as a response, the others as revisits of it. A task writes one archive, by
Spark's text writer with the record end as line end, so the files appear when the task commits.

Reading. Archives are read in splits, cut at every ``WARC/1.0`` line; each cut is a candidate
record. A task parses the candidates of its splits and tells for each where the next record
would start. Whether a candidate is a record or only looks like one inside a payload is decided
by the chain from the start of the file: first each split follows its own candidates to
where they leave the split; then pointer jumping over these exits finds the one entry of each
split that is reached from the file's start; then each split follows the chain from its entry.
What is not on the chain is rejected.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import BROADCAST_BYTES, arrow_map, hot_split_join, slices, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
# Payloads of fewer bytes are always written in full.
LEAST_REVISIT_BYTES = 0
# Stretches by which the parts of a record's payload are found again.
STRETCH = 1 << 24
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits give four letters."""
    digest, letters = F.sha1(payload), []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, 1))
    return F.concat(*letters)


def with_record_types(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``page``, ``url``, ``payload``, ``bytes``, ``digest`` and ``keeper``, the page that a revisit refers to (else null)."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{key}`").cast("bigint").alias("page"), F.col("url"), body.alias("payload"),
        F.octet_length(body).cast("bigint").alias("bytes"), base32_sha1(body.cast("binary")).alias("digest"),
    )
    groups = rows.groupBy("digest", "bytes").agg(F.max("page").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = stored(groups.where((F.col("n") > 1) & (F.col("bytes") >= least)))
    size = groups.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
    if size["groups"] * 120 <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(groups.drop("n")), ["digest", "bytes"], "left")
    else:  # rows of single payloads need no partner
        alone = rows.join(groups.select("digest", "bytes"), ["digest", "bytes"], "left_anti").withColumn("top", F.lit(None).cast("bigint"))
        joined = hot_split_join(rows, groups, ["digest", "bytes"], "n", size["rows"]).unionByName(alone)
    return joined.withColumn("keeper", F.when(F.col("page").isNull() | (F.col("page") != F.col("top")), F.col("top"))).drop("top")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT_BYTES) -> None:
    """One record per row. A null payload is an empty one; a null URL has no header line; line ends in URLs are escaped."""
    rows = with_record_types(pages, key, payload, least)
    revisit = F.col("keeper").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("page"))),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Date", F.lit(DATE)),
        F.when(revisit, _line("WARC-Refers-To", _urn(F.col("keeper")))).otherwise(""),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n")).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(folder)


_LENGTH = re.compile(rb"(?im)^Content-Length:[ \t]*(\d+)[ \t]*\r?$")
_FIELDS = {
    "page": re.compile(rb"(?im)^WARC-Record-ID:[ \t]*<urn:page:(-?\d+)>"),
    "kind": re.compile(rb"(?im)^WARC-Type:[ \t]*([\w-]+)"),
    "refers": re.compile(rb"(?im)^WARC-Refers-To:[ \t]*<urn:page:(-?\d+)>"),
    "url": re.compile(rb"(?im)^WARC-Target-URI:[ \t]*([^\r\n]*)"),
    "stated": re.compile(rb"(?im)^WARC-Payload-Digest:[ \t]*sha1:(\w+)"),
}
_CANDIDATE = (
    "file bigint, split bigint, at bigint, size bigint, next bigint, leaves bigint, head bigint, length bigint,"
    " page bigint, kind string, refers bigint, url string, stated string, digest string"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _candidate(at: int, chunk: bytes) -> dict:
    """What the text after a magic line says, if it is a record; ``next`` is null if it cannot be one."""
    row = {"at": at, "size": len(MAGIC) + len(chunk), "next": None, "head": None, "length": None, "digest": None}
    row |= dict.fromkeys(_FIELDS)
    end = chunk.find(b"\r\n\r\n")
    length = _LENGTH.search(chunk, 0, end) if end >= 0 else None
    if length:
        row["head"], row["length"] = len(MAGIC) + end + 4, int(length[1])
        row["next"] = at + row["head"] + row["length"] + len(END)
        for name, pattern in _FIELDS.items():
            if m := pattern.search(chunk, 0, end):
                text = m[1].decode(errors="replace")
                row[name] = int(text) if name in ("page", "refers") else text
        payload = chunk[end + 4 : end + 4 + row["length"]]
        if len(payload) == row["length"]:
            row["digest"] = sha1_base32(payload)
    return row


def _candidates_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of one split after the other; places are counted from the split's first magic line."""
    names = [c.split()[0] for c in _CANDIDATE.split(",")]
    schema = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "bigint" else pa.string()) for c in _CANDIDATE.split(",")])
    here, at, rows = None, 0, []

    def finished() -> Iterator[pa.RecordBatch]:
        """Follow each candidate, last first, to the place where its chain leaves the split."""
        leaves: dict[int, int | None] = {}
        for row in reversed(rows):
            after = row["next"]
            leaves[row["at"]] = row["leaves"] = after if after is None or after >= at else leaves.get(after)
            row["file"], row["split"] = here
        for i in range(0, len(rows), 10_000):
            part = rows[i : i + 10_000]
            yield pa.RecordBatch.from_pydict({n: [r[n] for r in part] for n in names}, schema)

    for batch in slices(batches):
        for file, split, chunk in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value")), strict=True):
            if (file, split) != here:
                if rows:
                    yield from finished()
                here, rows = (file, split), []
                at = -len(MAGIC) if split == 0 else 0  # before a file's first line stands nothing
            rows.append(_candidate(at, chunk) if at >= 0 else {**_candidate(at, b""), "size": len(MAGIC) + len(chunk)})
            at += len(MAGIC) + len(chunk)
    if rows:
        yield from finished()


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(folder)
    return text.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value")
    )


def _entries(candidates: DataFrame) -> DataFrame:
    """The places reached from the starts of the files, among those where chains enter a split: pointer jumping."""
    landing = candidates.select("file", F.col("leaves").alias("at")).where("at is not null").distinct()
    jump = stored(candidates.join(landing, ["file", "at"]).select("file", "at", F.col("leaves").alias("to")).where("to is not null"))
    start = candidates.where("at = 0 and split = 0").select("file", "at", F.col("leaves").alias("to"))
    reached = stored(start.select("file", "at").unionByName(start.where("to is not null").select("file", F.col("to").alias("at"))).distinct())
    count, before = reached.count(), -1
    while count != before:
        more = reached.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = stored(reached.unionByName(more).distinct())
        far = jump.select("file", F.col("at").alias("to"), F.col("to").alias("end"))
        jump = stored(jump.join(far, ["file", "to"]).select("file", "at", F.col("end").alias("to")))
        before, count = count, reached.count()
    return reached


def _walk_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates in order, with the entry of their split: those on the chain from it are records."""
    here, due = None, None
    for batch in slices(batches, 4096):
        keep = []
        for file, split, at, after, entry in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "at", "next", "entry")), strict=True):
            if (file, split) != here:
                here, due = (file, split), entry
            keep.append(at == due)
            if at == due:
                due = after
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keep, pa.bool_())], names=[*batch.schema.names, "record"])


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """All candidates of all archives below ``folder``, at their places in the files; ``record`` tells the real ones."""
    local = stored(arrow_map(_chunks(spark, folder), _candidates_task, _CANDIDATE))
    sizes = local.groupBy("file", "split").agg(F.max(F.col("at") + F.col("size")).alias("total"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("file", "split", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = local.join(bases, ["file", "split"]).withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "leaves")})
    candidates = stored(placed.where("at >= 0"))
    # a chain enters a split at one place only
    entries = candidates.join(_entries(candidates), ["file", "at"]).groupBy("file", "split").agg(F.min("at").alias("entry"))
    ordered = candidates.join(entries, ["file", "split"], "left").repartition("file", "split").sortWithinPartitions("file", "split", "at")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + ", record boolean"
    return stored(arrow_map(ordered, _walk_task, schema).drop("leaves"))


def _broken_parts(index: DataFrame) -> DataFrame:
    """Candidates that are parts of a record cut by magic lines in its payload, with the record's place as ``owner``."""
    whole = index.where("record and digest is null").select("file", F.col("at").alias("owner"), F.col("next").alias("end"))
    stretches = F.sequence(F.expr(f"owner div {STRETCH}"), F.expr(f"(end - 1) div {STRETCH}"))
    whole = whole.withColumn("stretch", F.explode(stretches))
    parts = index.select("file", "split", "at", "base", F.expr(f"at div {STRETCH}").alias("stretch"))
    return parts.join(whole, ["file", "stretch"]).where("at >= owner and at < end").select("file", "split", "at", "base", "owner")


def _parts_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, at = None, 0
    for batch in slices(batches):
        places = []
        for file, split, chunk in zip(*(batch.column(c).to_pylist() for c in ("file", "split", "value")), strict=True):
            if (file, split) != here:
                here, at = (file, split), -len(MAGIC) if split == 0 else 0
            places.append(at)
            at += len(MAGIC) + len(chunk)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["file", "split", "value", "local"])


def _payloads(spark: SparkSession, folder: str, parts: DataFrame, index: DataFrame) -> DataFrame:
    """``file``, ``at`` and ``payload`` of the records whose chunks are listed in ``parts``."""
    chunks = arrow_map(_chunks(spark, folder), _parts_task, "file bigint, split bigint, value binary, local bigint")
    parts = stored(parts.withColumn("local", F.col("at") - F.col("base")))
    if parts.count() * 64 <= BROADCAST_BYTES:  # few parts: the archives stay where they are read
        parts = F.broadcast(parts)
    found = chunks.join(parts, ["file", "split", "local"])
    texts = F.array_sort(F.collect_list(F.struct("at", F.concat(F.lit(MAGIC).cast("binary"), "value").alias("v"))))
    joined = F.aggregate(texts, F.lit("").cast("binary"), lambda s, x: F.concat(s, x["v"]))
    whole = found.groupBy("file", "owner").agg(joined.alias("v")).withColumnRenamed("owner", "at")
    heads = index.where("record").select("file", "at", "head", "length")
    return whole.join(heads, ["file", "at"]).select("file", "at", F.expr("substring(v, cast(head as int) + 1, cast(length as int))").alias("payload"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's ``page``, ``kind``, ``url``, ``refers`` and ``payload`` (empty for revisits)."""
    index = read_index(spark, folder)
    own = index.where("record").select("file", "split", "at", "base", F.col("at").alias("owner")).where("owner is not null")
    broken = _broken_parts(index)
    parts = own.join(broken.select("file", "owner").distinct(), ["file", "owner"], "left_anti").select("file", "split", "at", "base", "owner").unionByName(broken)
    records = index.where("record").select("file", "at", "page", "kind", "url", "refers")
    return records.join(_payloads(spark, folder, parts, index), ["file", "at"]).drop("file", "at")


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Every record's page, size and digest of its full payload, type, and the page that a revisit refers to.

    Digests are taken from the payloads as read; those of revisits from the record they refer to.
    """
    index = read_index(spark, folder)
    records = index.where("record")
    whole = records.where("digest is not null").select("page", "kind", "refers", "stated", "length", "digest")
    broken = records.where("digest is null")
    if not broken.isEmpty():
        cut = _payloads(spark, folder, _broken_parts(index), index).select(
            "file", "at", F.octet_length("payload").cast("bigint").alias("n"), base32_sha1(F.col("payload")).alias("d")
        )
        cut = broken.join(cut, ["file", "at"]).select("page", "kind", "refers", "stated", F.col("n").alias("length"), F.col("d").alias("digest"))
        whole = whole.unionByName(cut)
    found = stored(whole)
    responses = found.where("kind = 'response'")
    revisits = found.where("kind = 'revisit'").select("page", "refers", F.col("stated").alias("digest"))
    met = revisits.groupBy("refers", "digest").agg(F.count(F.lit(1)).alias("n"))
    of = responses.select(F.col("page").alias("refers"), "digest", "length").distinct().join(met, ["refers", "digest"])
    back = hot_split_join(revisits, of, ["refers", "digest"], "n", revisits.count())
    return responses.select(
        F.col("page").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"),
    ).unionByName(
        back.select(
            F.col("page").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
            F.lit("revisit").alias("record_type"), F.col("refers").alias("refers_to"),
        )
    )
