"""Submission packages: hashing, encryption, parts, manifest and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktorium import codes
from faktorium.functions import text
from faktorium.operators import skew

# Payload of one part; parts are assembled in one row, so this bounds a row.
MAX_PART_BYTES = 64 * 1024 * 1024
# Keys of 48 bytes and a package id each: a few MB at most.
MAX_BROADCAST_KEYS = 20_000


def hash_and_size(df: DataFrame, content: str = "content", prefix: str = "plain") -> DataFrame:
    """SHA-256 (base64) and size of the content."""
    value = F.col(content)
    return df.withColumn(f"{prefix}_sha256_b64", text.content_hash(value)).withColumn(f"{prefix}_size", text.byte_size(value))


def encrypt_documents(df: DataFrame, keys: DataFrame, on: str, content: str = "content") -> DataFrame:
    """Encrypt the content with the key and IV of its package.

    ``keys`` has ``on, key, iv``.  Keys come from a table and not from literals,
    so no plan text shows them.  Up to ``MAX_BROADCAST_KEYS`` keys are broadcast,
    so that contents stay where they are; more packages spread the join by themselves.
    """
    few = keys.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
    joined = df.join(F.broadcast(keys) if few else keys, on)
    return joined.withColumn(content, text.encrypt_content(F.col(content), F.col("key"), F.col("iv"))).drop("key", "iv")


def pack_parts(
    documents: DataFrame, max_bytes: int = MAX_PART_BYTES, parts: int | None = None
) -> DataFrame:
    """Add ``part_no`` from the running size inside a package, from 1.

    Needs ``package_id, doc_id (bigint), size_bytes``.  With ``parts`` the bytes
    are spread over that many parts, or over more where a part would exceed the
    limit.  Packages are cut into blocks of ids, which spreads a very large one.
    Leave the content out: ``build_parts`` takes it by document afterwards.
    """
    summed = skew.running_sum(
        documents, ["package_id"], [F.col("doc_id")], [F.floor(F.col("doc_id") / 100_000)], "size_bytes", "_end"
    )
    start = F.col("_end") - F.col("size_bytes")
    if parts is None:
        return summed.withColumn("part_no", (F.floor(start / max_bytes) + 1).cast("long")).drop("_end")
    totals = documents.groupBy("package_id").agg(F.sum("size_bytes").alias("_total"))
    count = F.greatest(F.lit(parts).cast("long"), F.ceil(F.col("_total") / max_bytes))
    number = F.call_function("div", start.cast("decimal(38,0)") * count, F.greatest(F.col("_total"), F.lit(1)).cast("decimal(19,0)")) + 1
    return summed.join(totals, "package_id").withColumn("part_no", number.cast("long")).drop("_end", "_total")


def build_parts(packed: DataFrame, documents: DataFrame, content: str = "content") -> DataFrame:
    """Payload, size and hash of every part: its documents in id order, one per line.

    ``documents`` has ``doc_id`` and the content, which joins only after packing.
    """
    filled = packed.join(documents.select("doc_id", content), "doc_id")
    grouped = filled.groupBy("package_id", "part_no").agg(
        F.count(F.lit(1)).alias("documents"), F.sort_array(F.collect_list(F.struct("doc_id", content))).alias("_docs")
    )
    payload = F.array_join(F.transform("_docs", lambda d: d[content]), "\n")
    parts = grouped.select("package_id", "part_no", "documents", payload.alias("payload"))
    return parts.withColumn("size_bytes", text.byte_size(F.col("payload"))).withColumn(
        "sha256_b64", text.content_hash(F.col("payload"))
    )


# Entries of one piece of a part list, and digests below one node of its tree.
MANIFEST_FAN_OUT = 1000


def _list_order() -> Column:
    """The items of a group in the order of ``_no``."""
    return F.sort_array(F.collect_list(F.struct("_no", "_item")))


def root_hashes(parts: DataFrame, fan_out: int = MANIFEST_FAN_OUT) -> DataFrame:
    """``package_id, sha256_b64``: the root of a tree over the part hashes of each package.

    A node is the hash of its at most ``fan_out`` hashes, one behind the other,
    by part number; the root of a package whose part numbers end at ``fan_out``
    or before is the hash of its whole list.  The number of steps follows the
    highest part number.
    """
    tops = parts.groupBy("package_id").agg(F.max("part_no").alias("_top"))
    highest = tops.agg(F.max("_top")).first()[0] or 0
    level = parts.select("package_id", (F.col("part_no") - 1).alias("_no"), F.col("sha256_b64").alias("_item")).join(tops, "package_id")
    reach = 1
    while reach == 1 or reach < highest:
        grouped = level.groupBy("package_id", "_top", F.floor(F.col("_no") / fan_out).alias("_group")).agg(_list_order().alias("_list"))
        hashed = text.content_hash(F.array_join(F.transform("_list", lambda x: x["_item"]), ""))
        # A package that has come to one node keeps it.
        kept = F.when(F.col("_top") <= reach, F.get("_list", F.lit(0))["_item"]).otherwise(hashed) if reach > 1 else hashed
        level = grouped.select("package_id", "_top", F.col("_group").alias("_no"), kept.alias("_item"))
        reach *= fan_out
    return level.select("package_id", F.col("_item").alias("sha256_b64"))


def package_manifest(parts: DataFrame, fan_out: int = MANIFEST_FAN_OUT) -> DataFrame:
    """Count, total size and root hash of each package; ``manifest_pieces`` has the part list.  No row grows with the package."""
    totals = parts.groupBy("package_id").agg(F.count(F.lit(1)).alias("part_count"), F.sum("size_bytes").alias("size_bytes"))
    return totals.join(root_hashes(parts, fan_out), "package_id")


def manifest_pieces(parts: DataFrame, fan_out: int = MANIFEST_FAN_OUT) -> DataFrame:
    """The part list in pieces of at most ``fan_out`` parts: ``package_id, piece_no`` from 1, ``parts`` in order."""
    entry = F.struct(
        F.col("part_no").alias("ordinalNumber"), F.col("size_bytes").alias("fileSize"), F.col("sha256_b64").alias("fileHash")
    )
    piece = (F.floor((F.col("part_no") - 1) / fan_out) + 1).alias("piece_no")
    return parts.groupBy("package_id", piece).agg(F.sort_array(F.collect_list(entry)).alias("parts"))


def build_manifest(parts: DataFrame, variant: int = 2, offline: bool = False, fan_out: int = MANIFEST_FAN_OUT) -> DataFrame:
    """Session request of a package as JSON: form code, offline flag, file size and hash, parts.

    ``package_id, piece_no, request``: the texts of a package, one behind the
    other by ``piece_no``, are the request.  Piece 0 opens it, every other one
    has at most ``fan_out`` parts and the last one closes it.
    """
    manifest = package_manifest(parts, fan_out)
    form = F.struct(
        F.lit(f"FA ({variant})").alias("systemCode"), F.lit(codes.SCHEMA_VERSION).alias("schemaVersion"), F.lit(codes.FORM_CODE).alias("value")
    )
    file = F.struct(F.col("size_bytes").alias("fileSize"), F.col("sha256_b64").alias("fileHash"))
    head = F.to_json(F.struct(form.alias("formCode"), F.lit(offline).alias("offlineMode"), file.alias("batchFile")))
    opening = manifest.select(
        "package_id", F.lit(0).cast("long").alias("piece_no"), F.concat(F.substring(head, F.lit(1), F.length(head) - 2), F.lit(',"fileParts":[')).alias("request")
    )
    pieces = manifest_pieces(parts, fan_out)
    ends = parts.groupBy("package_id").agg(
        (F.floor((F.min("part_no") - 1) / fan_out) + 1).alias("_first"), (F.floor((F.max("part_no") - 1) / fan_out) + 1).alias("_last")
    )
    entries = F.array_join(F.transform("parts", lambda part: F.to_json(part)), ",")
    listed = pieces.join(ends, "package_id").select(
        "package_id", "piece_no",
        F.concat(
            F.when(F.col("piece_no") > F.col("_first"), ",").otherwise(""), entries, F.when(F.col("piece_no") == F.col("_last"), "]}}").otherwise("")
        ).alias("request"),
    )
    return opening.unionByName(listed)


def _code(name: str) -> Column:
    return F.lit(codes.RULE_ERRORS[name][0])


def verify_parts(manifest_parts: DataFrame, parts: DataFrame, content: str = "payload") -> DataFrame:
    """Recompute size and hash of every part: catalogue codes of the mismatches, null when both agree.

    ``manifest_parts`` has ``package_id, part_no, size_bytes, sha256_b64``.
    """
    actual = parts.select(
        "package_id", "part_no", text.byte_size(F.col(content)).alias("_size"), text.content_hash(F.col(content)).alias("_hash")
    )
    joined = manifest_parts.join(actual, ["package_id", "part_no"], "left")
    size_error = F.when(~F.col("_size").eqNullSafe(F.col("size_bytes")), _code("part_size"))
    hash_error = F.when(~F.col("_hash").eqNullSafe(F.col("sha256_b64")), _code("part_hash"))
    return joined.withColumn("size_error", size_error).withColumn("hash_error", hash_error).drop("_size", "_hash")


def verify_files(declared: DataFrame, content: str = "content") -> DataFrame:
    """The same check for single documents with their own catalogue codes."""
    size_error = F.when(text.byte_size(F.col(content)) != F.col("size_bytes"), _code("file_size"))
    hash_error = F.when(text.content_hash(F.col(content)) != F.col("sha256_b64"), _code("file_hash"))
    return declared.withColumn("size_error", size_error).withColumn("hash_error", hash_error)
