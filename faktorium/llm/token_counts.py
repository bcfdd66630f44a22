"""Token counts of whole texts by a byte-level BPE file, with huge texts cut into overlapping chunks.

A text of at most ``step`` bytes is encoded in one task, as pieces between spaces: the splitter always starts a new match
at a space that a character other than white space follows, wherever it comes from, so the pieces count for themselves.
The library counts each distinct piece of a block; the counts of frequent pieces stay in a bounded table. A text where
white space follows a space is given to the library as it is. A longer text is cut into chunks of ``step`` code points that reach
``overlap`` code points into the next chunk; the chunks of one text are spread over all tasks and encoded with offsets.
Neighbouring encodings are spliced at a boundary proven to be stable, and the count is what lies between the splices.

A boundary is stable when both encodings start a pretoken there, at least ``MARGIN`` code points before the left chunk
ends. The splitter reads forward only: where a match ends depends on the characters from its start to three beyond its
end. So two scans that start a match at the same place go on alike, and what the left chunk found before the margin
doesn't depend on its end. The same holds for added tokens, which are shorter than the margin and found before the
splitter runs; a place inside one is no start for the left chunk, which sees the whole of it. As a check, the two
encodings must agree on every start from the splice to the margin.

Where two chunks have no such boundary in common (a word longer than the overlap), the overlap is widened: the left
chunk is encoded again together with the whole next one, and with all that follow as long as their splices fail too.
Rounds end when every splice holds. A word of any length ends up in one chunk, as it does in the encoding of the text.

Bounds: a worker holds a table of 2 * ``TABLE_ENTRIES`` short pieces; a task holds one text of at most ``step`` bytes, one chunk, or one run of chunks that a single word spans; the
cutting task holds one whole text. Splices of a text meet in one window of two short lists per chunk.

Edge cases: a null or empty text has no bytes and no tokens; repeated rows and repeated or null ids are counted row by
row; strings of added tokens inside a text are what the library makes of them by default; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faktorium.llm.texts import blocks, only
from faktorium.session import work_path

STEP = 1 << 15
OVERLAP = 1 << 10
#: More than the longest added token and than what the splitter looks ahead.
MARGIN = 64
LIMIT = 512
#: Bytes of text given to the library at once: its encodings take some 50 times as much.
BLOCK_BYTES = 1 << 18
TABLE_ENTRIES = 200_000
PIECE_CHARACTERS = 48

# Space before white space or at the end. Python's white space includes all of the splitter's.
_MARKED = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:]+)\\Z")
_NO_BOUNDARY = re.compile(r" (?:\s|\Z)")

_SPLICE = "row long, part long, last long, n long, head array<struct<at: long, token: long>>, tail array<struct<at: long, token: long>>"
_loaded: dict[str, object] = {}
_counts: dict[str, PieceCounts] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str):
    """The worker's tokenizer of one file: byte-level pretokens, no normaliser, neither truncation nor padding."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        added = found.get_added_tokens_decoder().values()
        if found.normalizer is not None or type(found.pre_tokenizer).__name__ != "ByteLevel":
            raise ValueError(f"{path}: splices are proven for byte-level files without a normaliser only")
        if any(len(a.content) >= MARGIN - 3 or a.lstrip or a.rstrip or a.single_word for a in added):
            raise ValueError(f"{path}: an added token reaches beyond the margin of a splice")
        _loaded[path] = found
    return _loaded[path]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class PieceCounts:
    """Token counts of pieces, each as it stands behind a space; what was used lately stays in the table."""

    def __init__(self, tokenizer, entries: int = TABLE_ENTRIES):
        self.tokenizer, self.entries = tokenizer, entries
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def encode(self, texts: Sequence[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lookup(self, pieces: set[str]) -> dict[str, int]:
        """Counts of all the pieces; unknown ones are counted by the library."""
        found = {p: self.recent[p] for p in pieces & self.recent.keys()}
        rest = pieces - found.keys()
        fresh = {p: self.older[p] for p in rest & self.older.keys()}
        unknown = rest - fresh.keys()
        marked = {p: m for p in unknown if (m := _MARKED.match(p))}
        if marked:
            # A match ends between a letter and a mark.
            words = self.lookup({m[1] for m in marked.values()})
            unknown -= words.keys()
            marks = list({m[2] for m in marked.values()})
            sizes = dict(zip(marks, self.encode(marks)))
            fresh.update((p, words[m[1]] + sizes[m[2]]) for p, m in marked.items())
            fresh.update((p, words[p]) for p in rest & words.keys())
        plain = list(unknown - marked.keys())
        fresh.update(zip(plain, self.encode([" " + p for p in plain])))
        found.update(fresh)
        if len(self.recent) >= self.entries:
            self.older, self.recent = self.recent, {}
        self.recent.update((p, n) for p, n in fresh.items() if len(p) <= PIECE_CHARACTERS)
        return found

    def count(self, texts: Sequence[str]) -> list[int]:
        """Token counts of whole texts."""
        counts, cut, whole = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if _NO_BOUNDARY.search(text):
                whole.append(i)
            elif text:
                first, *rest = text.split(" ")
                # Nothing stands before the first piece, unless the text begins with a space.
                cut.append((i, first, rest))
        heads = self.encode([first for _, first, _ in cut])
        known = self.lookup(set(chain.from_iterable(rest for _, _, rest in cut)))
        for (i, _, rest), head in zip(cut, heads):
            counts[i] = head + sum(map(known.__getitem__, rest))
        for i, n in zip(whole, self.encode([texts[i] for i in whole])):
            counts[i] = n
        return counts


def count_whole(path: str):
    """A ``mapInArrow`` function: ``doc_id, n_bytes, n_tokens`` of texts that are encoded whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = PieceCounts(load(path))
        for batch in blocks(batches, "text", BLOCK_BYTES):
            found = _counts[path].count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return count


def cut(step: int, overlap: int):
    """A ``mapInArrow`` function: the overlapping chunks of every text; the last one is longer than the overlap."""
    schema = pa.schema([("row", pa.int64()), ("part", pa.int64()), ("chunk", pa.string())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                value, out = text.as_py(), []
                for part in range(max(1, -((overlap - len(value)) // step))):
                    start = part * step
                    last = start + step + overlap >= len(value)
                    out.append((row, part, value[start:] if last else value[start : start + step + overlap]))
                    if len(out) == 32:
                        yield _batch(out, schema)
                        out = []
                if out:
                    yield _batch(out, schema)

    return chunks


def encode_chunks(path: str, step: int, overlap: int):
    """A ``mapInArrow`` function: tokens of every chunk, and the pretoken starts of its two overlaps.

    ``head`` and ``tail`` list places in the text with the number of tokens of the chunk before them.
    """
    place = pa.list_(pa.struct([("at", pa.int64()), ("token", pa.int64())]))
    schema = pa.schema([(n, pa.int64()) for n in ("row", "part", "last", "n")] + [("head", place), ("tail", place)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("row", "part", "last")]
            for row, part, last, chunk in zip(*names, batch.column("chunk")):
                chunk = chunk.as_py()
                found = tokenizer.encode_batch([chunk], add_special_tokens=False)[0]
                word = np.array(found.word_ids, np.int64)
                token = np.flatnonzero(np.diff(word, prepend=-1))
                at = np.array([o[0] for o in found.offsets], np.int64)[token]

                def listed(chosen: np.ndarray) -> list[dict]:
                    return [{"at": part * step + a, "token": t} for a, t in zip(at[chosen].tolist(), token[chosen].tolist())]

                inside = len(chunk) - overlap
                head = listed(at < overlap)
                tail = listed((at >= inside) & (at <= len(chunk) - MARGIN))
                yield _batch([(row, part, last, len(found), head, tail)], schema)

    return encode


def splice(encoded: DataFrame, step: int, overlap: int) -> DataFrame:
    """Add ``fails`` (the splice with the next chunk) and ``own``: the tokens between the splices of a chunk."""
    order = Window.partitionBy("row").orderBy("part")
    following = encoded.withColumn("next", F.lead("head").over(order))
    ends = (F.col("last") + 1) * step + overlap - MARGIN
    before_margin = F.filter("next", lambda x: x["at"] <= ends)
    common = F.array_min(F.array_intersect(F.transform("tail", lambda x: x["at"]), F.transform(before_margin, lambda x: x["at"])))
    rows = following.withColumn("at", F.when(F.col("next").isNotNull(), common))

    def shared(column) -> F.Column:
        return F.filter(column, lambda x: x["at"] >= F.col("at"))

    def places(column) -> F.Column:
        return F.transform(column, lambda x: x["at"])

    alike = places(shared(F.col("tail"))) == places(shared(before_margin))
    good = F.col("at").isNotNull() & alike
    rows = rows.withColumn("fails", F.col("next").isNotNull() & ~F.coalesce(good, F.lit(False)))
    stop = F.when(F.col("next").isNull(), F.col("n")).otherwise(F.get(shared(F.col("tail")), 0)["token"])
    skipped = F.when(F.col("next").isNotNull(), F.get(shared(F.col("next")), 0)["token"])
    rows = rows.withColumn("stop", stop).withColumn("skipped", F.lag(skipped).over(order))
    return rows.select(
        "row", "part", "last", "n", "head", "tail", "fails", (F.col("stop") - F.coalesce("skipped", F.lit(0))).alias("own")
    )


def widen(spliced: DataFrame, chunks: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Chunks that stay, and the texts of those that are encoded together because their splices fail."""
    order = Window.partitionBy("row").orderBy("part")
    starts = (~F.coalesce(F.lag("fails").over(order), F.lit(False))).cast("long")
    runs = spliced.withColumn("run", F.sum(starts).over(order))
    whole = Window.partitionBy("row", "run")
    runs = runs.withColumn("first", F.min("part").over(whole)).withColumn("end", F.max("last").over(whole))
    stay = runs.where((F.col("part") == F.col("first")) & (F.col("last") == F.col("end")))
    again = runs.where((F.col("part") != F.col("first")) | (F.col("last") != F.col("end")))
    members = again.select("row", "first", "end", F.explode(F.sequence("part", "last")).alias("part"))
    pieces = F.array_sort(F.collect_list(F.struct("part", "chunk")))
    texts = members.join(chunks, ["row", "part"]).groupBy("row", "first", "end").agg(pieces.alias("pieces"))
    cut_short = F.transform("pieces", lambda p: F.when(p["part"] < F.col("end"), F.substring(p["chunk"], 1, step)).otherwise(p["chunk"]))
    joined = texts.select("row", F.col("first").alias("part"), F.col("end").alias("last"), F.array_join(cut_short, "").alias("chunk"))
    return stay.select("row", "part", "last", "n", "head", "tail"), joined


def count_long(spark: SparkSession, rows: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """``row, n_tokens`` of a table of ``row, text``."""

    def stored(df: DataFrame, label: str) -> DataFrame:
        name = work_path(spark, label)
        df.write.parquet(name)
        return spark.read.parquet(name)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.mapInArrow(cut(step, overlap), "row long, part long, chunk string").repartition(parts, "row", "part")
    chunks = stored(pieces, "chunks")
    encode = encode_chunks(path, step, overlap)
    todo = chunks.select("row", "part", F.col("part").alias("last"), "chunk")
    spliced = stored(splice(todo.mapInArrow(encode, _SPLICE), step, overlap), "splices")
    while not spliced.where("fails").isEmpty():
        stay, again = widen(spliced, chunks, step)
        spliced = stored(splice(stay.unionByName(again.mapInArrow(encode, _SPLICE)), step, overlap), "splices")
    return spliced.groupBy("row").agg(F.sum("own").alias("n_tokens"))


def count_tokens(
    spark: SparkSession, documents: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT,
    step: int = STEP, overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row, as the library counts the whole text."""
    if not MARGIN < overlap <= step:
        raise ValueError("the overlap must be longer than the margin and no longer than the step")
    value = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = only(documents, doc_id=doc_id, text=value, n_bytes=F.octet_length(value).cast("long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    whole = rows.where(F.col("n_bytes") <= step).mapInArrow(count_whole(path), f"doc_id {id_type}, n_bytes long, n_tokens long")

    # The long texts get a stored row number, so that every later step means the same row.
    name = work_path(spark, "long-texts")
    rows.where(F.col("n_bytes") > step).withColumn("row", F.monotonically_increasing_id()).write.parquet(name)
    long = spark.read.schema(f"doc_id {id_type}, text string, n_bytes long, row long").parquet(name)
    counted = long.select("doc_id", "n_bytes", "row").join(count_long(spark, long.select("row", "text"), path, step, overlap), "row")
    both = whole.unionByName(counted.select("doc_id", "n_bytes", "n_tokens"))
    return both.withColumn("over_limit", F.col("n_tokens") > limit)
