"""Collections: named tables of documents on shared storage, in versions.

A version is a numbered head file that names what makes it up: directories of Parquet files (parts), and a table of deletion
bitmaps. A head is created exclusively, so that of two writers that begin from one version the second fails, and is never
replaced; the highest number is the current version, and older ones stay readable until ``vacuum``.

- Appends add a part. Deletes, updates and replacements write a bitmap of the rows that go, addressed by file and row, and a
  part with the rows that come; what they leave alone is not written again. Bitmaps are merged on reading, and only files that
  have one are read with it. ``compact`` writes what is left as one part.
- Metadata is a VARIANT column. Keys that a collection names as hot are columns of their own besides, of which each file's
  least and greatest value are known (zone maps): filters on them skip files, and what is left is pushed into the scan.
- Rows of a part are sorted by the hot keys and the id; each file has its range of ids and a Bloom filter, so that ids are
  looked up in the few files that may hold them.

What the library relies on (content hash, chunk index, document id) are columns of their own, which no caller's metadata can
overwrite.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import errors
from siltstone.functions import validate
from siltstone.operators.filters import Lookup, columns_of, compiled, kind_of, may_match
from siltstone.plans.joins import bounded
from siltstone.plans.scratch import written

SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.VariantType()),
    T.StructField("document_id", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("codes", T.BinaryType()),
    T.StructField("vmin", T.DoubleType()),
    T.StructField("scale", T.DoubleType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])
COLUMNS = [f.name for f in SCHEMA]
#: Rows of a file, about, and bytes of its texts and vectors, about, whatever its rows are.
ROWS_PER_FILE, BYTES_PER_FILE = 250_000, 128 << 20
#: Bits of a bitmap row (what bitmap_construct_agg makes), bits of a Bloom filter for each row, and how many an id sets.
BITS, BLOOM_BITS, BLOOM_HASHES = 32_768, 16, 5
#: Ids are looked up through Bloom filters if there are at most so many; more are joined.
FEW = 1000


def has_bit(bits: Column, at: Column) -> Column:
    """Whether a bit of a bitmap is set; ``at`` from 0."""
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1


@dataclass(frozen=True)
class Store:
    """All collections under one path."""

    spark: SparkSession
    path: str

    # ---- files -----------------------------------------------------------------------------

    def file(self, path: str):
        """(file system, path) for a path."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def create_only(self, path: str, text: str) -> None:
        """Creates a file whole, or fails if it is there: by a hard link on local file systems, by a rename where that never
        replaces (HDFS), and else by exclusive creation, which object stores offer as a conditional write."""
        fs, p = self.file(path)
        taken = errors.StorageError(f"{path} was written by another writer")
        kind = fs.getUri().getScheme()
        aside = kind in ("file", "hdfs", "viewfs", "webhdfs")
        if fs.exists(p):
            raise taken
        fs.mkdirs(p.getParent())
        at = self.file(f"{p.getParent()}/new-{uuid.uuid4().hex}")[1] if aside else p
        try:
            stream = fs.create(at, False)
        except Exception as e:  # the store's own error for a file that is there
            raise taken from e
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        if not aside:
            return
        try:
            if kind == "file":
                nio, own = self.spark._jvm.java.nio.file, lambda x: self.spark._jvm.java.nio.file.Path.of(fs.makeQualified(x).toUri())
                try:
                    nio.Files.createLink(own(p), own(at))
                except Exception as e:
                    raise taken from e
            elif not fs.rename(at, p):
                raise taken
        finally:
            fs.delete(at, False)

    def created(self, path: str) -> str | None:
        """A file's text; None if it is not there."""
        fs, p = self.file(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _heads(self, name: str) -> list[str]:
        fs, p = self.file(f"{self.path}/{name}/heads")
        if not fs.exists(p):
            return []
        return sorted(n for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("head-"))

    def _write(self, name: str, value: dict[str, Any]) -> None:
        try:
            self.create_only(f"{self.path}/{name}/heads/head-{value['version']:012d}", json.dumps(value))
        except errors.StorageError as e:
            raise errors.StorageError(f"version {value['version']} of {name!r} was written by another writer") from e

    def _head(self, name: str, version: int | None = None) -> dict[str, Any]:
        heads = self._heads(name)
        if not heads:
            raise errors.CollectionNotFound(f"no collection {name!r}")
        own = heads[-1] if version is None else f"head-{version:012d}"
        if own not in heads:
            raise errors.StorageError(f"{name!r} has no version {version}")
        return json.loads(self.created(f"{self.path}/{name}/heads/{own}"))

    # ---- definition ------------------------------------------------------------------------

    def create(self, name: str, dimension: int, metadata: Mapping[str, Any] | None = None, hot: Mapping[str, str] | None = None, rows_per_file: int = ROWS_PER_FILE) -> None:
        """A new collection; cosine is its space if ``metadata`` (key ``space``) names no other.

        ``hot``: metadata keys and their types (string, bigint, double, boolean) by which files are laid out and skipped.
        """
        validate.check_name(name)
        validate.check_metadata(metadata)
        if not isinstance(dimension, int) or isinstance(dimension, bool) or dimension <= 0:
            raise errors.ValidationError("the dimension must be a positive whole number")
        if not set((hot or {}).values()) <= {"string", "bigint", "double", "boolean"}:
            raise errors.ValidationError("hot keys are strings, bigints, doubles or booleans")
        if rows_per_file <= 0:
            raise errors.ValidationError("files must have rows")
        if self.exists(name):
            raise errors.CollectionExists(f"collection {name!r} is there already")
        self._write(name, {"name": name, "dimension": dimension, "metadata": {"space": "cosine"} | dict(metadata or {}), "version": 0, "parts": [], "deleted": None, "next_seq": 0, "hot": dict(hot or {}), "rows_per_file": rows_per_file})

    def ensure(self, name: str, dimension: int) -> None:
        if not self.exists(name):
            self.create(name, dimension, {"auto_created": True})

    def drop(self, name: str) -> None:
        self._head(name)
        fs, p = self.file(f"{self.path}/{name}")
        fs.delete(p, True)

    def exists(self, name: str) -> bool:
        return bool(self._heads(name))

    def names(self) -> list[str]:
        fs, p = self.file(self.path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and self.exists(s.getPath().getName()))

    def info(self, name: str) -> dict[str, Any]:
        return self._head(name) | {"documents": self.count(name)}

    def version(self, name: str) -> int:
        return self._head(name)["version"]

    # ---- what files hold -------------------------------------------------------------------

    def _schema(self, head: dict[str, Any]) -> T.StructType:
        hot = [T.StructField(f"hot_{i}", T._parse_datatype_string(t)) for i, t in enumerate(head["hot"].values())]
        return T.StructType([*SCHEMA.fields, *hot])

    def _stats(self, head: dict[str, Any]) -> DataFrame:
        """(part, file, rows, id_lo, id_hi, lo_0, hi_0 ...): a row for each file."""
        return self.spark.read.parquet(*[f"{self.path}/{head['name']}/{p}/files" for p in head["parts"]])

    def _deleted(self, head: dict[str, Any]) -> DataFrame | None:
        """(part, file, bucket, bits): the rows that are deleted, 32,768 rows of a file in a row."""
        return self.spark.read.parquet(f"{self.path}/{head['name']}/{head['deleted']}") if head["deleted"] else None

    def _read(self, head: dict[str, Any], files: list[tuple[str, str]] | None = None, places: bool = False) -> DataFrame:
        """The live rows, of ``files`` (part, file) only if they are given; with ``places`` also their part, file and row.

        Files without deletions are read as they are.
        """
        base, schema = f"{self.path}/{head['name']}", self._schema(head)
        deleted = self._deleted(head)
        place = lambda d: d.select("*", F.element_at(F.split("_metadata.file_path", "/"), -3).alias("__part"), F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        empty = self.spark.createDataFrame([], schema)
        if not head["parts"] or files == []:
            return empty.selectExpr("*", "'' __part", "'' __file", "0L __row") if places else empty
        reader = self.spark.read.schema(schema)
        if deleted is None:
            d = reader.parquet(*([f"{base}/{p}/rows" for p in head["parts"]] if files is None else [f"{base}/{p}/rows/{f}" for p, f in files]))
            return place(d) if places else d
        known = [(r["part"], r["file"]) for r in self._stats(head).select("part", "file").collect()] if files is None else files
        touched = {(r["part"], r["file"]) for r in deleted.select("part", "file").distinct().collect()}
        parts = []
        if clean := [x for x in known if x not in touched]:
            d = reader.parquet(*[f"{base}/{p}/rows/{f}" for p, f in clean])
            parts.append(place(d) if places else d)
        if dirty := [x for x in known if x in touched]:
            d = place(reader.parquet(*[f"{base}/{p}/rows/{f}" for p, f in dirty]))
            gone = bounded(deleted.select(F.col("file").alias("__f"), F.col("bucket").alias("__b"), F.col("bits").alias("__bits")))
            d = d.join(gone, (F.col("__file") == F.col("__f")) & (F.floor(F.col("__row") / BITS) == F.col("__b")), "left")
            d = d.where(F.col("__bits").isNull() | ~has_bit(F.col("__bits"), F.col("__row") % BITS)).drop("__f", "__b", "__bits")
            parts.append(d if places else d.drop("__part", "__file", "__row"))
        out = parts[0]
        for d in parts[1:]:
            out = out.unionByName(d)
        return out

    def _lookup(self, d: DataFrame, head: dict[str, Any]) -> Lookup:
        """Hot keys by their columns where the filter's value is of their type, others in the variant."""
        general, hot = columns_of(d, "metadata"), {k: (i, t) for i, (k, t) in enumerate(head["hot"].items())}

        def find(key: str, value: Any) -> Column:
            if key in hot and hot[key][1] == kind_of(value):
                return d[f"hot_{hot[key][0]}"]
            return general(key, value)

        return find

    def files_for(self, name: str, filters: Mapping[str, Any] | None = None, version: int | None = None) -> list[tuple[str, str]]:
        """(part, file) of the files that may hold rows for which ``filters`` hold, by their zone maps."""
        head = self._head(name, version)
        if not head["parts"]:
            return []
        hot = {k: (i, t) for i, (k, t) in enumerate(head["hot"].items())}

        def zone(key: str, value: Any) -> tuple[Column, Column] | None:
            if key in hot and hot[key][1] == kind_of(value):
                return F.col(f"lo_{hot[key][0]}"), F.col(f"hi_{hot[key][0]}")
            return None

        rows = self._stats(head).where(may_match(filters, zone)).select("part", "file").collect()
        return sorted((r["part"], r["file"]) for r in rows)

    def _files_of(self, head: dict[str, Any], ids: DataFrame) -> list[tuple[str, str]]:
        """(part, file) of the files that may hold one of a few ids: by ranges, then by Bloom filters."""
        if not head["parts"]:
            return []
        base = f"{self.path}/{head['name']}"
        wanted = F.broadcast(ids.select(F.col("id").alias("__id")))
        near = self._stats(head).join(wanted, (F.col("id_lo") <= F.col("__id")) & (F.col("id_hi") >= F.col("__id"))).select("part", "file", "width", "__id")
        each = near.select("*", F.explode(_bloom_bits(F.col("__id"), F.col("width"))).alias("at")).select("part", "file", "__id", F.floor(F.col("at") / BITS).alias("bucket"), (F.col("at") % BITS).alias("bit"))
        blooms = self.spark.read.parquet(*[f"{base}/{p}/blooms" for p in head["parts"]])
        met = each.join(blooms, ["part", "file", "bucket"], "left").groupBy("part", "file", "__id").agg(F.bool_and(F.coalesce(has_bit(F.col("bits"), F.col("bit")), F.lit(False))).alias("all"))
        return sorted((r["part"], r["file"]) for r in met.where("all").select("part", "file").distinct().collect())

    # ---- reading ---------------------------------------------------------------------------

    def table(self, name: str, missing_is_empty: bool = False, version: int | None = None) -> DataFrame:
        """All rows of the current or another version; Catalyst prunes columns and pushes filters into the scan."""
        try:
            head = self._head(name, version)
        except errors.CollectionNotFound:
            if not missing_is_empty:
                raise
            return self.spark.createDataFrame([], SCHEMA)
        return self._read(head).select(*COLUMNS)

    def part(self, name: str, part: str) -> DataFrame:
        """All rows that a part was written with, deleted ones too."""
        return self.spark.read.schema(self._schema(self._head(name))).parquet(f"{self.path}/{name}/{part}/rows").select(*COLUMNS)

    def dead(self, name: str, version: int | None = None) -> DataFrame | None:
        """The rows of a version's parts that are deleted, with ``part``; None if there are none. Only files with deletions are read."""
        head = self._head(name, version)
        deleted = self._deleted(head)
        if deleted is None:
            return None
        touched = sorted({(r["part"], r["file"]) for r in deleted.select("part", "file").distinct().collect()})
        d = self._read(head | {"deleted": None}, touched, places=True)
        d = d.join(bounded(deleted.select(F.col("file").alias("__f"), F.col("bucket").alias("__b"), "bits")), (F.col("__file") == F.col("__f")) & (F.floor(F.col("__row") / BITS) == F.col("__b")))
        return d.where(has_bit(F.col("bits"), F.col("__row") % BITS)).select(*COLUMNS, F.col("__part").alias("part"))

    def _filtered(self, name: str, filters: Mapping[str, Any] | None) -> DataFrame:
        head = self._head(name)
        if not filters:
            return self._read(head)
        d = self._read(head, self.files_for(name, filters, head["version"]))
        return d.where(compiled(filters, self._lookup(d, head)))

    def documents(self, name: str, filters: Mapping[str, Any] | None = None) -> DataFrame:
        """Rows without vectors and codes; files that no row of the filters can be in are not opened."""
        return self._filtered(name, filters).select(*COLUMNS).drop("embedding", "codes", "vmin", "scale")

    def codes(self, name: str, filters: Mapping[str, Any] | None = None) -> DataFrame:
        return self._filtered(name, filters).where("codes is not null").select("id", "codes", "vmin", "scale", "seq")

    def get(self, name: str, id: str) -> DataFrame:
        """The row of an id, from the files whose range and Bloom filter it passes."""
        if not id:
            raise errors.ValidationError("an id must not be empty")
        head = self._head(name)
        one = self.spark.range(1).select(F.lit(id).alias("id"))
        return self._read(head, self._files_of(head, one)).where(F.col("id") == id).select(*COLUMNS).limit(1)

    def count(self, name: str, version: int | None = None) -> int:
        """From what is known of files and bitmaps: no rows are read."""
        head = self._head(name, version)
        if not head["parts"]:
            return 0
        n = self._stats(head).agg(F.sum("rows")).first()[0] or 0
        deleted = self._deleted(head)
        return n - (deleted.agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0 if deleted is not None else 0)

    # ---- writing ---------------------------------------------------------------------------

    def _shaped(self, rows: DataFrame, head: dict[str, Any]) -> DataFrame:
        have = {f.name: (F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)) for f in SCHEMA}
        if "metadata" in rows.columns and rows.schema["metadata"].dataType == T.StringType():
            have["metadata"] = F.parse_json("metadata")
        have["created_at"] = F.coalesce(have["created_at"], F.current_timestamp())
        # Insertion order: ids of rows already written keep theirs, new ones follow.
        have["seq"] = F.coalesce(have["seq"], F.monotonically_increasing_id() + head["next_seq"])
        d = rows.select(*[have[f.name].alias(f.name) for f in SCHEMA])
        return d.select("*", *[F.try_variant_get("metadata", f"$['{k}']", t).alias(f"hot_{i}") for i, (k, t) in enumerate(head["hot"].items())])

    def _check(self, rows: DataFrame, dimension: int, needed: bool = True) -> None:
        vector = F.col("embedding") if "embedding" in rows.columns else F.lit(None).cast("array<float>")
        wrong = F.coalesce(F.size(vector) != dimension, F.lit(False)) & vector.isNotNull()
        text = F.col("text").isNotNull() if needed else F.col("text").isNotNull() & (F.col("text") != "")
        bad = F.col("id").isNull() | wrong | (vector.isNull() if needed else F.lit(False)) | ~F.coalesce(validate.valid_text(F.col("text"), 2**31 - 1) if needed else text | F.col("text").isNull(), F.lit(False))
        if rows.where(bad).limit(1).count():
            raise errors.ValidationError(f"every row needs an id, a text and an embedding of {dimension} components")
        if "metadata" in rows.columns:
            kind = rows.schema["metadata"].dataType
            parsed = F.try_parse_json("metadata") if kind == T.StringType() else F.col("metadata")
            keys = F.json_object_keys(F.to_json(parsed))
            held = rows.where(F.size(validate.reserved_keys(keys)) > 0).limit(1)
            if kind in (T.StringType(), T.VariantType()) and self._guarded and held.count():
                raise errors.ValidationError("metadata must not have reserved keys")

    #: Rows that callers bring must not have reserved keys in their metadata; the library's own ingestion sets some.
    _guarded: bool = False

    def guarded(self) -> Store:
        """This store, refusing rows whose metadata has reserved keys."""
        return Store(self.spark, self.path, True)

    def _part(self, head: dict[str, Any], rows: DataFrame) -> tuple[str, int]:
        """Writes a part: its rows, what is known of its files, and their Bloom filters. Returns its name and the next number of a row."""
        part = f"v{head['version'] + 1}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/{head['name']}/{part}"
        shaped = written(self._shaped(rows, head))
        # Files are bounded by rows and by bytes, as rows may be long.
        n, size = shaped.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + 4 * F.greatest(F.size("embedding"), F.lit(0))), F.lit(0))).first()
        order = [f"hot_{i}" for i in range(len(head["hot"]))] + ["id"]
        shaped.repartitionByRange(max(1, -(-n // head["rows_per_file"]), -(-size // BYTES_PER_FILE)), *order).sortWithinPartitions(*order).write.parquet(f"{at}/rows")
        d = self.spark.read.schema(self._schema(head)).parquet(f"{at}/rows").select("id", "seq", *order[:-1], F.col("_metadata.file_name").alias("file"))
        zones = [f(F.col(c)).alias(f"{a}_{c[4:]}") for c in order[:-1] for f, a in ((F.min, "lo"), (F.max, "hi"))]
        files = d.groupBy("file").agg(F.count("*").alias("rows"), F.min("id").alias("id_lo"), F.max("id").alias("id_hi"), F.max("seq").alias("seq"), *zones)
        width = (F.ceil(F.col("rows") * BLOOM_BITS / BITS) * BITS).alias("width")
        files.select(F.lit(part).alias("part"), "*", width).coalesce(1).write.parquet(f"{at}/files")
        files = self.spark.read.parquet(f"{at}/files")
        bits = d.join(bounded(files.select("file", "width")), "file").select("file", F.explode(_bloom_bits(F.col("id"), F.col("width"))).alias("at"))
        blooms = bits.groupBy("file", F.floor(F.col("at") / BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BITS).alias("bits"))
        blooms.select(F.lit(part).alias("part"), "*").write.parquet(f"{at}/blooms")
        return part, max(head["next_seq"], (files.agg(F.max("seq")).first()[0] or 0) + 1)

    def _commit(self, head: dict[str, Any], rows: DataFrame | None = None, gone: DataFrame | None = None, more: dict[str, Any] | None = None) -> int:
        """A new version: ``rows`` come as a part, ``gone`` (__part, __file, __row) go as bitmaps; ``more`` goes into its head. Returns its number."""
        new = head | {"version": head["version"] + 1} | (more or {})
        if rows is not None:
            part, new["next_seq"] = self._part(head, rows)
            new["parts"] = [*head["parts"], part]
        if gone is not None:
            own = gone.groupBy(F.col("__part").alias("part"), F.col("__file").alias("file"), F.floor(F.col("__row") / BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("__row") % BITS).alias("bits"))
            before = self._deleted(head)
            own = own if before is None else own.unionByName(before).groupBy("part", "file", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            new["deleted"] = f"deleted-v{new['version']}-{uuid.uuid4().hex[:8]}"
            own.coalesce(1).write.option("compression", "zstd").parquet(f"{self.path}/{head['name']}/{new['deleted']}")
        self._write(head["name"], new)
        return new["version"]

    def _placed(self, head: dict[str, Any], key: str, values: DataFrame) -> DataFrame:
        """The live rows whose ``key`` is among ``values``, with their places; few ids are looked up in the files that may hold them."""
        values = values.select(key).where(F.col(key).isNotNull()).distinct()
        files = self._files_of(head, values) if key == "id" and values.limit(FEW + 1).count() <= FEW else None
        return self._read(head, files, places=True).join(bounded(values), key, "left_semi")

    def append(self, name: str, rows: DataFrame) -> int:
        """Adds rows (id, text, embedding ...); rows whose id is there already, or earlier in ``rows``, are not added.

        Returns the new version.
        """
        head = self._head(name)
        self._check(rows, head["dimension"])
        return self._commit(head, rows.dropDuplicates(["id"]).join(self._read(head).select("id"), "id", "left_anti"))

    def append_batch(self, name: str, rows: DataFrame, source: str, batch: int) -> int:
        """Adds a batch of a source that numbers its batches, and whose ids no other batch has: the rows that are there are not read.

        The number goes into the head with the rows, so that a batch that is brought again adds nothing.
        """
        head = self._head(name)
        done = head.get("streams", {})
        if done.get(source, -1) >= batch:
            return head["version"]
        self._check(rows, head["dimension"])
        return self._commit(head, rows, more={"streams": done | {source: batch}})

    def delete(self, name: str, ids: DataFrame) -> int:
        """Removes the rows of ``ids`` (id): a bitmap is written, no rows are."""
        head = self._head(name)
        return self._commit(head, gone=written(self._placed(head, "id", ids).select("__part", "__file", "__row")))

    def update(self, name: str, rows: DataFrame) -> int:
        """Replaces text and metadata, and embeddings where given, of rows (id, text, metadata, embedding); codes of
        changed embeddings are dropped, to be made anew. Of rows that share an id one counts. Only those rows are written."""
        head = self._head(name)
        self._check(rows, head["dimension"], needed=False)
        new = written(rows.dropDuplicates(["id"]).select("id", F.col("text").alias("t"), (F.col("embedding") if "embedding" in rows.columns else F.lit(None)).cast("array<float>").alias("e"), (F.col("metadata") if "metadata" in rows.columns else F.lit(None).cast("string")).alias("m")))
        old = written(self._placed(head, "id", new))
        m = F.parse_json("m") if new.schema["m"].dataType == T.StringType() else F.col("m")
        changed = old.join(new, "id").withColumns({
            "text": F.coalesce("t", "text"),
            "codes": F.when(F.col("e").isNull(), F.col("codes")),
            "embedding": F.coalesce("e", "embedding"),
            "metadata": F.coalesce(m, F.col("metadata")),
            "updated_at": F.current_timestamp(),
        }).select(*COLUMNS)
        return self._commit(head, changed, old.select("__part", "__file", "__row"))

    def replace(self, name: str, content_hashes: DataFrame, rows: DataFrame) -> int:
        """One step for force replacement: rows with these content hashes go, ``rows`` come; a failure changes nothing.

        Rows whose id stays in the collection are not added.
        """
        head = self._head(name)
        self._check(rows, head["dimension"])
        gone = written(self._placed(head, "content_hash", content_hashes).select("id", "__part", "__file", "__row"))
        left = self._read(head).select("id").join(gone.select("id"), "id", "left_anti")
        return self._commit(head, rows.dropDuplicates(["id"]).join(left, "id", "left_anti"), gone.select("__part", "__file", "__row"))

    def compact(self, name: str) -> int:
        """Writes the live rows as one part without deletions; older versions stay readable until ``vacuum``."""
        head = self._head(name)
        part, top = self._part(head, self._read(head).select(*COLUMNS))
        new = head | {"version": head["version"] + 1, "parts": [part], "deleted": None, "next_seq": top}
        self._write(name, new)
        return new["version"]

    def vacuum(self, name: str) -> int:
        """Removes directories that the current version does not name, and older heads; returns how many directories."""
        head = self._head(name)
        keep = {*head["parts"], "heads", head["deleted"], f"index-{head['version']}", "segments"}
        fs, p = self.file(f"{self.path}/{name}")
        gone = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName() not in keep]
        _, segments = self.file(f"{self.path}/{name}/segments")
        if fs.exists(segments):
            gone += [s.getPath() for s in fs.listStatus(segments) if not any(s.getPath().getName().startswith(x) for x in head["parts"])]
        for g in [*gone, *(self.file(f"{self.path}/{name}/heads/{h}")[1] for h in self._heads(name)[:-1])]:
            fs.delete(g, True)
        return len(gone)


def _bloom_bits(id: Column, width: Column) -> Column:
    """The bits that an id sets in a Bloom filter of ``width`` bits, by double hashing."""
    a, b = F.xxhash64(id), F.xxhash64(id, F.lit(1))
    at = lambda i: F.pmod(F.pmod(a, width) + i * F.pmod(b, width), width)
    return F.array(*[at(i) for i in range(BLOOM_HASHES)])
