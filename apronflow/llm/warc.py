"""WARC archives: a deterministic sharded writer and its reader.

A payload is stored once, in the response of the largest ``page_id`` that has it; other pages get
revisit records that refer to it. Responses are range-partitioned and sorted by payload digest,
revisits by a digest of their page id: both are uniform, so shards are even whatever the pages are
like, and a shard's content depends on the pages alone. Payloads that repeat within a task leave it
once. A shard is cut into files when their compressed size reaches ``roll_bytes``; a file is written
under a temporary name, renamed when whole, and counts once the manifest (a Parquet table that Spark
commits as a whole) lists it. A task that runs twice writes the same bytes under the same name.

Nulls and odd rows: a null html is an empty payload; a null url leaves its header out; null page ids
count as smaller than others; of rows that repeat a response's page and payload, all but one are
revisits of it; other columns are not archived; an empty table gives no files.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apronflow.sources.scratch import materialize

SHARD_BYTES = 128 << 20
ROLL_BYTES = 32 << 20
MIN_SHARDS = 16
DATE = "2024-01-01T00:00:00Z"
LEVEL = 4
MANIFEST = "file string, records bigint, bytes bigint, sha1 string"
RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def _first_payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each payload once a task; of a later page with a larger id only the id and url."""
    names = ["digest", "page_id", "url", "payload"]
    largest: dict[str, tuple] = {}
    later: dict[str, tuple] = {}
    for batch in batches:
        keep = []
        for i, (digest, page, url) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
            rank = (page is not None, page or 0)
            if digest not in largest:
                keep.append(i)
                largest[digest] = rank
            elif rank > largest[digest]:
                largest[digest] = rank
                later[digest] = (page, url)
        yield pa.RecordBatch.from_arrays(batch.take(pa.array(keep, pa.int64())).columns, names)
    rows = [(d, *x, None) for d, x in later.items()]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _record(kind: str, page: int | None, url: str | None, digest: str, payload: bytes, size: int, refers: int | None, copy: int) -> bytes:
    import uuid

    name = lambda *x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, x)))}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(kind, page, digest, copy)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name('response', refers, digest, 1)}"]
        head += [] if refers is None else [f"X-Refers-To-Page: {refers}"]
    head += [] if page is None else [f"X-Page: {page}"]
    head += [f"X-Payload-Length: {size}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _writer(folder: str, kind: str, roll: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import hashlib
        import uuid
        import zlib

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        done: list[tuple] = []
        state: dict = {"shard": None, "file": 0, "sink": None}

        def close() -> None:
            if state["sink"] is not None:
                state["sink"].close()
                store.move(state["temporary"], posixpath.join(base, state["name"]))
                done.append((state["name"], state["records"], state["bytes"], state["sum"].hexdigest()))
                state["sink"] = None
                state["file"] += 1

        def add(shard: int, record: bytes) -> None:
            if shard != state["shard"]:
                close()
                state.update(shard=shard, file=0)
            if state["sink"] is None:
                name = f"{kind}-{shard:06d}-{state['file']:05d}.warc.gz"
                store.create_dir(posixpath.join(base, "_temporary"), recursive=True)
                temporary = posixpath.join(base, "_temporary", f"{name}.{uuid.uuid4().hex}")
                state.update(name=name, temporary=temporary, sink=store.open_output_stream(temporary), records=0, bytes=0, sum=hashlib.sha1())
            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            data = packer.compress(record) + packer.flush()
            state["sink"].write(data)
            state["sum"].update(data)
            state["records"] += 1
            state["bytes"] += len(data)
            if state["bytes"] >= roll:
                close()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(start, 256).columns))

        if kind == "response":
            held = None

            def respond() -> None:
                if held:
                    shard, _, page, url, payload = held
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    add(shard, _record(kind, page, url, digest, payload, len(payload), None, 1))

            # sorted by digest, the largest page first; any row of a digest may hold the payload
            for shard, digest, page, url, payload in rows():
                if held and held[1] == digest:
                    if held[4] is None:
                        held[4] = payload
                else:
                    respond()
                    held = [shard, digest, page, url, payload]
            respond()
        else:
            for shard, _, page, url, digest, size, refers, copy in rows():
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                add(shard, _record(kind, page, url, name, b"", size, refers, copy))
        close()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], ["file", "records", "bytes", "sha1"])

    return write


def write_archives(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, min_shards: int = MIN_SHARDS) -> None:
    """Write ``pages`` (page_id, url, html) to ``folder``, which all machines must reach."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    typed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = typed.withColumn("digest", F.sha1("payload"))
    keys = rows.groupBy("page_id", "digest", F.octet_length("payload").cast("long").alias("size")).agg(F.max("url").alias("url"), F.count(F.lit(1)).alias("copies"))
    keys = materialize(keys, "pages")
    total = keys.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    shards = max(min_shards, -(-total // shard_bytes))
    shard = lambda digest: F.expr(f"cast((cast(conv(substring({digest}, 1, 10), 16, 10) as bigint) * {shards}L) div 1099511627776L as int)")

    once = rows.select("digest", "page_id", "url", "payload").mapInArrow(_first_payloads, "digest string, page_id bigint, url string, payload binary")
    placed = once.select(shard("digest").alias("shard"), "*").repartitionById(shards, "shard")
    placed = placed.sortWithinPartitions("shard", "digest", F.desc_nulls_last("page_id"), F.desc_nulls_last("url"))
    responses = placed.mapInArrow(_writer(folder, "response", roll_bytes), MANIFEST)

    owners = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.sum("copies").alias("_all")).filter("_all > 1")
    again = keys.join(owners.hint("merge"), "digest")
    again = again.withColumn("_more", F.col("copies") - F.col("page_id").eqNullSafe(F.col("refers_to")).cast("int"))
    again = again.filter("_more > 0").withColumn("copy", F.explode_outer(F.expr("sequence(2L, _more + 1)")))
    again = again.withColumn("place", F.md5(F.concat_ws("-", F.col("page_id").cast("string"), "digest", F.col("copy").cast("string"))))
    again = again.select(shard("place").alias("shard"), "place", "page_id", "url", "digest", "size", "refers_to", "copy")
    again = again.repartitionById(shards, "shard").sortWithinPartitions("shard", "place")
    revisits = again.mapInArrow(_writer(folder, "revisit", roll_bytes), MANIFEST)
    responses.union(revisits).write.mode("overwrite").parquet(f"{folder}/manifest")


def _reader(folder: str):
    import base64
    import hashlib
    import zlib

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]

    def records(data: bytes) -> Iterator[tuple]:
        rest = memoryview(data)
        while len(rest):
            unpacker = zlib.decompressobj(31)
            record = unpacker.decompress(rest)
            if not unpacker.eof:
                raise ValueError("an archive ends within a record")
            rest = rest[len(rest) - len(unpacker.unused_data) :]
            head, _, tail = record.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            payload = tail[: int(fields["Content-Length"])]
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            if fields["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError("a payload differs from its digest")
            number = lambda name: int(fields[name]) if name in fields else None
            yield number("X-Page"), number("X-Payload-Length"), digest, fields["WARC-Type"], number("X-Refers-To-Page"), fields.get("WARC-Target-URI")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size, sha1 in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_stream(posixpath.join(base, name), compression=None) as source:
                    data = source.read()
                if len(data) != size or hashlib.sha1(data).hexdigest() != sha1:
                    raise ValueError(f"{name} differs from the manifest")
                rows = list(records(data))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return read


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files in the manifest, with files and payloads checked against their digests.

    The manifest's rows are dealt to tasks, which open their files one by one: no file is listed,
    shuffled or broadcast.
    """
    listed = spark.read.parquet(f"{folder}/manifest").select("file", "bytes", "sha1")
    total = listed.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    dealt = listed.repartition(max(MIN_SHARDS, -(-total // SHARD_BYTES)), "file")
    return dealt.mapInArrow(_reader(folder), RECORDS)
