"""Token counts as rollups that are maintained by deltas.

A batch is a set of signed events: an insert adds a document's counts to the totals of its
source, language and tokenizer version, a delete takes them off, a revision takes off the
old ones and adds the new. A batch is summed once (partial sums before the shuffle) and
written to a folder of its own. It is committed by a manifest, a small file that is renamed to the
batch's name, which fails where that name is taken: of two writers of one batch one commits, and a batch
that is there already is left alone, so it may be sent again after any failure. Totals are
the sums over the committed batches. A compaction writes the sums of the batches that it saw in one listing,
and their names; a batch that is committed meanwhile isn't among them and so counts by itself.

The driver holds names of batches, never anything of the documents. Data of a commit that failed is removed.

Results for edge cases: null source or language are groups of their own; a null or empty
text has no tokens but is a document, a text may be of any length; totals of groups whose documents are all gone are
left out; repeated rows count each time; an empty table gives no totals; other columns play no part, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import file_system, pick, scratch_dir, spread, table, tune, written
from .bpe import Lengths, coder
from .tokens import PIECE, encoder, texts, vocabulary

KEYS = ("source", "lang", "version")
SUMS = ("documents", "tokens", "chars")
SCHEMA = "source string, lang string, version string, documents long, tokens long, chars long"


class Rollup:
    """Totals in a shared folder: data/ has the sums, commits/ the manifests batch-<name> and until-<number>."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _there(self, name: str) -> bool:
        fs, p = file_system(self.spark, f"{self.path}/commits/{name}")
        return fs.exists(p)

    def _manifests(self) -> list[str]:
        fs, root = file_system(self.spark, f"{self.path}/commits")
        return sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []

    def _data(self, name: str) -> str:
        """The folder that a manifest names."""
        fs, p = file_system(self.spark, f"{self.path}/commits/{name}")
        stream = fs.open(p)
        try:
            return f"{self.path}/data/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def _live(self) -> tuple[str | None, list[str], set[str]]:
        """Of one listing: the last compaction, the batches that it doesn't hold, and the names of all."""
        names = self._manifests()
        batches = {n.removeprefix("batch-") for n in names if n.startswith("batch-")}
        last = max((n for n in names if n.startswith("until-")), default=None)
        held = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self._data(last)}/names").collect()} if last else set()
        return last, sorted(batches - held), batches

    def committed(self) -> set[str]:
        return self._live()[2]

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Add a batch of events (source, lang, version, sign, tokens, chars); False if it was there already."""
        if not re.fullmatch(r"[\w.]+", batch):
            raise ValueError(f"a batch's name has letters, digits, _ and . only: {batch!r}")
        if self._there(f"batch-{batch}"):
            return False
        sums = events.groupBy(*KEYS).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"), F.sum(F.col("sign") * F.col("chars")).alias("chars"))
        return self._publish(sums.select(*KEYS, *[F.col(c).cast("long").alias(c) for c in SUMS]), f"batch-{batch}", None)

    def _publish(self, sums: DataFrame, name: str, names: DataFrame | None) -> bool:
        folder = uuid.uuid4().hex
        sums.write.parquet(f"{self.path}/data/{folder}/sums")
        if names is not None:
            names.write.parquet(f"{self.path}/data/{folder}/names")
        if self._named(folder, name):
            return True
        fs, p = file_system(self.spark, f"{self.path}/data/{folder}")
        fs.delete(p, True)
        return False

    def _named(self, folder: str, name: str) -> bool:
        """Rename a manifest to ``name``, unless that is taken; the rename doesn't overwrite."""
        from py4j.protocol import Py4JJavaError

        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, draft = file_system(self.spark, f"{self.path}/drafts/{folder}")
        _, target = file_system(self.spark, f"{self.path}/commits/{name}")
        out = fs.create(draft, True)
        out.write(folder.encode())
        out.close()
        fs.mkdirs(target.getParent())
        if fs.exists(target):
            fs.delete(draft, False)
            return False
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(target), plain)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _sums(self, manifests: list[str]) -> DataFrame:
        if not manifests:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self._data(n)}/sums" for n in manifests])
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("documents != 0 or tokens != 0 or chars != 0")

    def totals(self) -> DataFrame:
        last, batches, _ = self._live()
        return self._sums([last] * bool(last) + [f"batch-{b}" for b in batches])

    def compact(self) -> bool:
        """Write the totals so far as one, with the names of their batches; False if another compaction came first."""
        last, batches, names = self._live()
        number = int(last.removeprefix("until-")) + 1 if last else 0
        rows = self.spark.createDataFrame([(n,) for n in sorted(names)], "batch string")
        return self._publish(self._sums([last] * bool(last) + [f"batch-{b}" for b in batches]).coalesce(1), f"until-{number:09d}", rows.coalesce(1))


def token_counter(path: str) -> Callable[[str | None], int]:
    """How many ids a text has: by cached pieces of byte-level vocabularies, by the automaton of word-level ones, else by the library."""
    own = encoder(path)
    if own.ordinary is None and getattr(own.tokenizer.model, "end_of_word_suffix", None):
        return coder(path).count
    lengths = Lengths(lambda piece: len(own.ordinary(piece)))
    return lambda t: sum(map(lengths.__getitem__, PIECE.findall(t))) if t and own.cuts(t) else len(own.encode(t)) // 4


def count_tokens(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """(doc_id, source, lang, chars, n_<version>, stripped_<version>) for each row: ids of the text, and of it without outer white space."""
    docs = spread(pick(docs, doc_id="doc_id", text="text", source="source", lang="lang"))
    tune(docs.sparkSession)
    names = [f"{k}_{v}" for v in versions for k in ("n", "stripped")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [token_counter(p) for p in versions.values()]
        for b in batches:
            own = texts(b.column(1))
            columns = [b.column(0), b.column(2), b.column(3), pa.array([len(t or "") for t in own], pa.int64())]
            for count in counters:
                whole = [count(t) for t in own]
                columns += [pa.array(whole, pa.int64()), pa.array([n if not t or t == t.strip() else count(t.strip()) for n, t in zip(whole, own, strict=True)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "lang", "chars", *names])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {key}, source string, lang string, chars long, " + ", ".join(f"{n} long" for n in names))


def inserts(counts: DataFrame, version: str, sign: int = 1) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("version"), F.lit(sign).cast("long").alias("sign"), F.col(f"n_{version}").alias("tokens"), "chars")


def deletes(counts: DataFrame, version: str) -> DataFrame:
    return inserts(counts, version, -1)


def revisions(counts: DataFrame, version: str, new: str) -> DataFrame:
    """The old counts taken off and those of column ``new`` added."""
    added = counts.select("source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("sign"), F.col(new).alias("tokens"), "chars")
    return inserts(counts, version, -1).unionByName(added)


#: Documents of fewer tokens are deleted and come again in the query.
SHORT = 16


def op6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents under two tokenizers, after an exercise of deltas that ends at the whole table.

    For each version: inserts with provisional counts (of texts without outer white space), revisions to the
    whole texts' counts, deletes of short documents, and their return; batches are sent twice, with a compaction between.
    """
    versions = {v: vocabulary(f"{v}.json") for v in ("byte_bpe_50k", "word_bpe_49k")}
    counts = written(count_tokens(table(spark, sf_dir, "documents"), versions), "counts")
    rollup = Rollup(spark, f"{scratch_dir(spark)}/rollup")
    for v in versions:
        first = counts.withColumns({f"n_{v}": F.col(f"stripped_{v}"), f"stripped_{v}": F.col(f"n_{v}")})
        short = counts.where(F.col(f"n_{v}") < SHORT)
        batches = {
            f"{v}.1.inserts": inserts(first, v),
            f"{v}.2.revisions": revisions(first.where(F.col(f"n_{v}") != F.col(f"stripped_{v}")), v, f"stripped_{v}"),
            f"{v}.3.deletes": deletes(short, v),
            f"{v}.4.returns": inserts(short, v),
        }
        for i, name in enumerate([*batches, *batches]):
            rollup.commit(name, batches[name])
            if i == 2:
                rollup.compact()
    return rollup.totals()
