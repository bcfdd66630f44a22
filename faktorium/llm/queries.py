"""The registered queries of the training-data operators over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faktorium.llm import (
    exact_dedup, language, licenses, manifest, mixing, packing, phrases, repeats, simhash, texts, token_counts, token_files, tokens,
    toxicity, winnowing,
)
from faktorium.plans.tables import read_table
from faktorium.session import configure, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: function(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_files(spark, documents(spark, sf_dir), tokens.default_path())
    return token_files.checked(token_files.read_files(spark, manifest))


@query(
    "op3_exact_dedup",
    """
    WITH d AS (
      SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
      FROM documents
    ), g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(spark, documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    model = toxicity.fit(rows, read_table(spark, sf_dir, "labels"))
    return toxicity.predict(spark, model, rows).select(
        "doc_id", texts.is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op5_winnowing")
def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.against_next(spark, documents(spark, sf_dir))


MIX_SQL = r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5(coalesce(doc_id::VARCHAR, '')) AS h
      FROM documents
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
    ), w AS (
      SELECT source, source_size, 3 * source_size AS cap, CASE k % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS weight FROM s
    ), f AS (
      SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
      FROM w WINDOW earlier AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), t AS (
      SELECT source, source_size, least(cap::DOUBLE, weight * (
               SELECT level FROM f WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1)) AS target
      FROM f
    ), e AS (
      SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 100000000)::BIGINT ELSE 0 END AS expected,
             ('0x' || md5('mix-1|' || coalesce(source, ''))[1:8])::BIGINT % 100000000 AS phase
      FROM t
    ), r AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(bin(size)) * 1000 + bin(size)[1:3]::INT, h, doc_id::VARCHAR, size) - 1 AS rank
      FROM d
    ), c AS (
      SELECT r.doc_id, r.size, e.source_size, e.target,
             (rank * expected + phase + expected) // 100000000 - (rank * expected + phase) // 100000000 AS copies
      FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source
    )
    SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM c
"""


@query("op6_mix_sources", MIX_SQL)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "sizes")
    rows = texts.only(documents(spark, sf_dir), doc_id="doc_id", source="source", size=mixing.word_count(F.col("text")))
    rows.write.parquet(path)
    mixed = mixing.copies(spark.read.parquet(path))
    return mixed.select(
        "row.doc_id", "row.size", "source_size", "target", (F.col("copies") * F.col("row.size")).alias("taken"), "copies"
    )


@query("op7_license_scan")
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summarise(licenses.scan(documents(spark, sf_dir).select("doc_id", "text")))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    model = language.fit(rows, language.learnable())
    predicted = language.predict(spark, model, rows.select("doc_id", "text"))
    return predicted.select(
        "doc_id", texts.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )


@query("op9_pack_windows")
def op9_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokens.default_path())


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_repeats")
def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(spark, documents(spark, sf_dir))


def merkle_columns(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The manifest and the check of every row, some of them tampered with: a text that lost its line ends."""
    name = F.col("doc_id").cast("string")
    tampered = F.when(F.crc32(name.cast("binary")) % 2 == 0, F.translate(F.col("text"), "\n", ""))
    found = manifest.build(spark, rows, changed=tampered)
    folded = manifest.fold(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


MERKLE_SQL = """
    WITH RECURSIVE d AS (
      SELECT *, row_number() OVER () AS row_no,
             doc_id IS NOT NULL AND list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
               lambda ch: list_transform(range(8), lambda k: (ascii(ch)::BIGINT >> k) & 1)))),
               lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))) & 1 = 1 AS tampered
      FROM documents
    ), f AS (
      SELECT row_no, doc_id, source, text, tampered,
             coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
             || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
             replace(text, chr(10), '') AS other
      FROM d
    ), leaves AS (
      SELECT row_no, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN tampered AND text IS NOT NULL THEN sha256(head || strlen(other) || ':' || other) END AS changed
      FROM f
    ), placed AS (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
             count(*) OVER (PARTITION BY source) AS size
      FROM leaves
    ), low AS (
      SELECT 0 AS lvl, source, place, leaf AS digest, size FROM placed
      UNION ALL
      SELECT lvl + 1, source, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (size + 2) // 3
      FROM low WHERE size > 1 GROUP BY lvl, source, place // 3, size
    ), subroots AS (
      SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS size
      FROM low WHERE size = 1
    ), high AS (
      SELECT 0 AS lvl, place, subroot AS digest, size FROM subroots
      UNION ALL
      SELECT lvl + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (size + 2) // 3
      FROM high WHERE size > 1 GROUP BY lvl, place // 3, size
    ), runs AS (
      SELECT false AS top, source, lvl, place // 3 AS run, list(digest ORDER BY place) AS nodes FROM low WHERE size > 1 GROUP BY ALL
      UNION ALL
      SELECT true, NULL, lvl, place // 3, list(digest ORDER BY place) FROM high WHERE size > 1 GROUP BY ALL
    ), steps AS (
      SELECT p.row_no, r.top, r.lvl, r.nodes, p.place // (3 ** r.lvl)::BIGINT % 3 AS i
      FROM placed p JOIN runs r ON NOT r.top AND r.source IS NOT DISTINCT FROM p.source AND r.run = p.place // (3 ** (r.lvl + 1))::BIGINT
      UNION ALL
      SELECT p.row_no, r.top, r.lvl, r.nodes, s.place // (3 ** r.lvl)::BIGINT % 3
      FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
      JOIN runs r ON r.top AND r.run = s.place // (3 ** (r.lvl + 1))::BIGINT
    ), numbered AS (
      SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY top, lvl) AS step FROM steps
    ), proofs AS (
      SELECT row_no, sha256(string_agg(array_to_string(list_filter(nodes, lambda x, k: k <> i + 1), ''), '' ORDER BY step)) AS proof
      FROM numbered GROUP BY row_no
    ), folded AS (
      SELECT row_no, 0 AS step, coalesce(changed, leaf) AS node FROM placed
      UNION ALL
      SELECT row_no, n.step, sha256(array_to_string(list_transform(n.nodes, lambda x, k: CASE WHEN k = n.i + 1 THEN f.node ELSE x END), ''))
      FROM folded f JOIN numbered n USING (row_no) WHERE n.step = f.step + 1
    ), ends AS (SELECT row_no, max_by(node, step) AS folded_root FROM folded GROUP BY row_no)
    SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root,
           e.folded_root = r.digest AS verified
    FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN ends e USING (row_no)
    LEFT JOIN proofs q USING (row_no) CROSS JOIN (SELECT digest FROM high WHERE size = 1) r
"""


@query("op11_merkle_manifest", MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_columns(spark, documents(spark, sf_dir))


PHRASE_SQL = r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents
    ), spoken AS (
      SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
    ), starts AS (
      SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM spoken
    ), counts AS (
      SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS n
      FROM starts, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= 30
    ), candidates AS (
      SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS words FROM counts WHERE k > 1
    ), cuts AS (
      SELECT lang, phrase, words, k, a, unnest(range(1, k)) AS j FROM candidates
    ), scored AS (
      SELECT c.lang, c.phrase, c.a, c.j, f.n AS l, g.n AS r, (2000000::HUGEINT * c.a // (f.n + g.n))::BIGINT AS score
      FROM cuts c
      JOIN counts f ON f.lang = c.lang AND f.phrase = array_to_string(c.words[1 : c.j], ' ')
      JOIN counts g ON g.lang = c.lang AND g.phrase = array_to_string(c.words[c.j + 1 : c.k], ' ')
    ), lowest AS (
      SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
    ), inside AS (
      SELECT DISTINCT c.lang, array_to_string(c.words[i : i + m - 1], ' ') AS phrase, c.a
      FROM candidates c, (VALUES (2), (3)) AS sizes(m), (VALUES (1), (2), (3)) AS places(i)
      WHERE m < c.k AND i + m - 1 <= c.k
    ), swallowed AS (
      SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inside i USING (lang, phrase) WHERE 100::HUGEINT * i.a >= 80::HUGEINT * c.a
    ), totals AS (
      SELECT lang, sum(len(words))::BIGINT AS n FROM spoken GROUP BY lang
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM lowest JOIN totals USING (lang) ANTI JOIN swallowed USING (lang, phrase) QUALIFY rank <= 2000
"""


@query("op12_collocations", PHRASE_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(spark, documents(spark, sf_dir))


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, documents(spark, sf_dir), token_counts.default_path())
