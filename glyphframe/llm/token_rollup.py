"""Token counts as rollups that deltas maintain.

A change is an insert, a delete or a revision of one document's count: revision takes the old count back and adds the new
one, which may be of another source, language or tokenizer version. A batch of changes is added up by source, language
and tokenizer into signed deltas, written as a folder of its own, and committed by one small file under the batch's name,
made only if there is none. A folder that no such file names, left by a job that died, is nothing. A name that is
committed already is not applied again, and is an error if its deltas differ from those committed.

Totals are the last manifest's base and the deltas that are committed and not in it, read in one scan. compact() takes one
list of those, sums exactly these to a new base, and commits it by the next manifest, which holds the names; then their
commits are moved to done and their deltas dropped at the next compaction, as readers may still be at them. A batch
that is committed meanwhile is in the next list. As all is additive, batches may come in any order.

Null sources, languages and tokenizers are groups of their own; a null count is 0. Repeated changes in one batch count as
often as they are there. Groups whose documents and tokens are both 0 again have no row; an empty batch adds nothing.
Rows that repeat an id are documents each; a null id is counted, and copies no other's text.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import map_text

KEYS = ("source", "lang", "tokenizer")
DELTA = T.StructType([*[T.StructField(k, T.StringType()) for k in KEYS], T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType())])


def rank_file_tokens(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns and tokens: the number of ids that a public byte-level BPE vocabulary gives a whole text."""

    def work() -> Callable[[list], dict]:
        import base64

        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: {"tokens": pa.array([len(encoding.encode_ordinary((x or b"").decode("utf-8", "replace"))) for x in texts], pa.int64())}

    return map_text(docs, text, list(keep), T.StructType([T.StructField("tokens", T.LongType())]), work)


def inserted(rows: DataFrame) -> DataFrame:
    """Signed changes of rows (source, lang, tokenizer, tokens) that are new."""
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def deleted(rows: DataFrame) -> DataFrame:
    new = inserted(rows)
    return new.select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    return deleted(old).union(inserted(new))


class Rollup:
    """Totals by source, language and tokenizer in a folder that all executors share.

    Two jobs may commit at once under different names; of two compactions at once one does nothing.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, folder: str) -> list[str]:
        fs, place = self._place(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getLen()) if fs.exists(place) else []

    def _get(self, path: str) -> dict | None:
        """A small file's content; None if there is none, or it is empty as its writer died."""
        fs, place = self._place(path)
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text else None

    def _put(self, path: str, content: dict) -> bool:
        """Makes a small file; False if there is one."""
        fs, place = self._place(path)
        if fs.exists(place) and not fs.getFileStatus(place).getLen():
            fs.delete(place, False)
        try:
            stream = fs.create(place, False)
        except Exception:
            if self._get(path) is None:
                raise
            return False
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        return True

    def _drop(self, path: str) -> None:
        fs, place = self._place(path)
        fs.delete(place, True)

    def _committed(self, name: str) -> dict | None:
        return self._get(f"pending/{name}") or self._get(f"done/{name}")

    def commit(self, name: str, changes: DataFrame) -> bool:
        """Adds a batch of signed changes under its name; False if it was committed before, and nothing is done.

        ValueError if other changes were committed under that name.
        """
        if not re.fullmatch(r"[A-Za-z0-9-]+", name):
            raise ValueError("a batch is named by letters, digits and hyphens")
        folder = f"deltas/{name}-{uuid.uuid4().hex}"
        deltas = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.parquet(f"{self.root}/{folder}")
        rows = self.spark.read.schema(DELTA).parquet(f"{self.root}/{folder}")
        n, digest = rows.agg(F.count("*"), F.sum(F.xxhash64(*DELTA.names).cast("decimal(38,0)"))).first()
        batch = {"folder": folder, "groups": n, "digest": str(digest)}
        new = not self._committed(name) and self._put(f"pending/{name}", batch)
        if not new:
            self._drop(folder)
            was = self._committed(name)
            if (was["groups"], was["digest"]) != (n, batch["digest"]):
                raise ValueError(f"batch {name} is committed with other changes")
        return new

    def _state(self) -> tuple[int, dict, dict[str, dict]]:
        """The last manifest's number and content, and the batches committed since, all of one moment."""
        while True:
            before = self._names("manifests")
            pending = {n: self._get(f"pending/{n}") for n in self._names("pending")}
            if before == self._names("manifests"):
                manifest = self._get(f"manifests/{before[-1]}") if before else {"base": None, "names": [], "retired": []}
                return int(before[-1]) if before else 0, manifest, {n: b for n, b in pending.items() if b and n not in manifest["names"]}

    def _sum(self, manifest: dict, batches: dict[str, dict]) -> DataFrame:
        folders = [manifest["base"]] * bool(manifest["base"]) + [b["folder"] for b in batches.values()]
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        _, manifest, batches = self._state()
        return self._sum(manifest, batches)

    def compact(self) -> bool:
        """A new base of all that is committed; False if another compaction came first."""
        version, manifest, batches = self._state()
        self._settle(manifest)  # if the last compaction died before it did
        base = f"base/{uuid.uuid4().hex}"
        self._sum(manifest, batches).write.parquet(f"{self.root}/{base}")
        retired = [b["folder"] for b in batches.values()] + [manifest["base"]] * bool(manifest["base"])
        made = {"base": base, "names": sorted(batches), "retired": retired}
        if not self._put(f"manifests/{version + 1:08d}", made):
            self._drop(base)
            return False
        self._settle(made)
        for folder in manifest["retired"]:
            self._drop(folder)
        if version:
            self._drop(f"manifests/{version - 1:08d}")
        return True

    def _settle(self, manifest: dict) -> None:
        """Moves the commits of a manifest's batches to done: known by name for ever, but listed no more."""
        for name in manifest["names"]:
            if batch := self._get(f"pending/{name}"):
                self._put(f"done/{name}", batch)
                self._drop(f"pending/{name}")


def rolled_up(rollup: Rollup, counted: DataFrame, versions: tuple[str, str]) -> DataFrame:
    """Totals after three batches over counted (doc_id, source, lang, copy, bytes, tokens): all documents are inserted by
    the first tokenizer, that of bytes, revised to the second, and those that copy a smaller id's text deleted. The second
    batch comes twice and counts once."""

    def version(rows: DataFrame, tokenizer: str, column: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(column).alias("tokens"))

    first, second = version(counted, versions[0], "bytes"), version(counted, versions[1], "tokens")
    rollup.commit("1-insert", inserted(first))
    rollup.commit("2-revise", revised(first, second))
    rollup.commit("2-revise", revised(first, second))
    rollup.compact()
    rollup.commit("3-delete", deleted(version(counted.where("copy"), versions[1], "tokens")))
    return rollup.totals()


def counted_documents(docs: DataFrame, ranks_file: str, pattern: str, id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """doc_id, source, lang, text_id (a digest; null for a null text), bytes and tokens of each document."""
    whole = F.col(f"`{text}`").cast("string")
    own = docs.select(F.col(f"`{id}`").alias("doc_id"), *[F.col(f"`{c}`").cast("string").alias(n) for c, n in ((source, "source"), (lang, "lang"))], F.md5(whole).alias("text_id"), F.coalesce(F.octet_length(whole), F.lit(0)).cast("long").alias("bytes"), whole.alias("text"))
    return rank_file_tokens(own, ranks_file, pattern, keep=("doc_id", "source", "lang", "text_id", "bytes"))


def with_copies(counted: DataFrame) -> DataFrame:
    """counted with copy: whether a smaller id has the same text; of null ids with the same text none is a copy."""
    first = counted.where("text_id is not null").groupBy("text_id").agg(F.min("doc_id").alias("first"))
    return counted.join(first, "text_id", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
