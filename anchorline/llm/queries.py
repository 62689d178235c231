"""The corpus operators as named queries over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from anchorline.llm import (
    decontaminate, fill_middle, language, licenses, merkle, minhash, mixing, neighbours, rlz_dedup, shards, suffix_dedup,
    token_files, toxicity,
)
from anchorline.llm.stages import KEEP, TOKENIZER
from anchorline.llm.frames import crc_held_out, table, text_bytes
from anchorline.session import cut_lineage


def op1_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = rlz_dedup.remove_repeated_words(table(spark, sf_dir, "documents"), with_kept=False)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_language(docs.where(~crc_held_out()))
    found = language.predict_language(docs, model)
    return found.select("doc_id", crc_held_out().alias("held_out"), "lang_pred", "score")


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = toxicity.fit_toxicity(docs.where(~crc_held_out()), labels.where(~crc_held_out()))
    found = toxicity.tag_documents(docs, field)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select(
        "doc_id", crc_held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"),
        spans.alias("spans"),
    )


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_soft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumn("domain", mixing.quality_domain())
    mixed = mixing.soft_mixture(table(spark, sf_dir, "documents"), labels, KEEP)
    shares = [F.get("posteriors", k).alias(f"p_{d}") for k, d in enumerate(KEEP)]
    return mixed.select("doc_id", "n_tokens", "domain", *shares, "rate")


def op8_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"), with_kept=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(
        "doc_id",
        (text_bytes() + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    dealt = shards.histogram_sort(cut_lineage(narrow), "size", ["doc_id", "text_crc32", "row"], shards=24)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
        merkle.leaf_digest(["doc_id", "source", "lang", merkle.encoded(F.col("n_chars") + 1), "text"]),
    )
    proofs = merkle.document_manifest(table(spark, sf_dir, "documents"), tampered).proofs()
    folded = proofs.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", merkle.proof_digest().alias("proof_sha256"),
        merkle.folded_root(F.coalesce("changed", "digest")).alias("folded_root"),
    )
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = fill_middle.restore(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rebuilt.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rlz_dedup": op1_rlz_dedup,
    "op2_byte_network": op2_byte_network,
    "op5_toxic_spans": op5_toxic_spans,
    "op3_string_tiling": op3_string_tiling,
    "op6_soft_mixture": op6_soft_mixture,
    "op8_hilbert_neighbours": op8_hilbert_neighbours,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op7_token_files": op7_token_files,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_histogram_shards": op10_histogram_shards,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_license_scan": op12_license_scan,
    "op13_fill_middle": op13_fill_middle,
}
_CRC = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split({x}, ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda r, s: xor(r >> 1, (r & 1) * 3988292384))))"""
_FIELD = "CASE WHEN {x} IS NULL THEN '-' ELSE concat(strlen(CAST({x} AS VARCHAR)), ':', {x}) END"
_LEAF = "sha256(concat(" + ", ".join(_FIELD.format(x=c) for c in ("doc_id", "source", "lang", "{n}", "text")) + "))"
_WORDS = r"list_filter(string_split_regex({text}, '[\x09-\x0D\x20]+'), lambda w: w <> '')"

SQL: dict[str, str] = {
    "op1_rlz_dedup": f"""WITH split AS (SELECT doc_id, coalesce({_WORDS.format(text="text")}, []) AS ws FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS run
          FROM split, unnest(range(1, len(ws) - 48)) AS t(i) WHERE len(ws) >= 50),
        holders AS (SELECT run, min(doc_id) AS holder FROM windows GROUP BY run),
        gone AS (SELECT DISTINCT doc_id, i + step AS place FROM windows JOIN holders USING (run), range(50) AS r(step)
          WHERE holder < doc_id),
        placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM split),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS words FROM placed ANTI JOIN gone USING (doc_id, place)
          GROUP BY doc_id),
        counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
          sha256(coalesce(words, '')) AS kept_sha256
        FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id LEFT JOIN counts c ON c.doc_id = s.doc_id""",
    "op9_near_duplicates": f"""WITH RECURSIVE split AS (SELECT doc_id,
          coalesce({_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, []) AS ws
          FROM documents),
        shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS run
          FROM split, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b
          ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * common >= 75 * (x.n + y.n - common)),
        near AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS other FROM documents
          UNION SELECT r.doc_id, near.b FROM reach r JOIN near ON near.a = r.other)
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
        LEFT JOIN sizes s ON s.doc_id = d.doc_id""",
    "op11_merkle_manifest": f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g,
          {_LEAF.format(n="n_chars")} AS leaf,
          CASE WHEN {_CRC.format(x="CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_LEAF.format(n="(n_chars + 1)")} END AS changed
          FROM documents),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
          count(*) OVER (PARTITION BY g) AS n FROM leaves),
        nodes AS (SELECT g, 0 AS up, pos, leaf AS digest, n FROM placed
          UNION ALL SELECT g, up + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM nodes
          WHERE n > 1 GROUP BY g, up, pos // 2, n),
        groups AS (SELECT g, up AS height, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n
          FROM nodes WHERE n = 1),
        tops AS (SELECT 0 AS up, pos, subroot AS digest, n FROM groups
          UNION ALL SELECT up + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tops
          WHERE n > 1 GROUP BY up, pos // 2, n),
        sides AS (SELECT doc_id, p.pos AS row, p.g, s.up, CAST(p.pos >> s.up AS INT) % 2 AS right_side, x.digest
          FROM placed p JOIN (SELECT DISTINCT g, up FROM nodes WHERE n > 1) s ON s.g = p.g
          LEFT JOIN nodes x ON x.g = p.g AND x.up = s.up AND x.pos = xor(p.pos >> s.up, 1)
          UNION ALL SELECT doc_id, p.pos, p.g, height + s.up, CAST(q.pos >> s.up AS INT) % 2, x.digest
          FROM placed p JOIN groups q ON q.g = p.g JOIN (SELECT DISTINCT up FROM tops WHERE n > 1) s ON true
          LEFT JOIN tops x ON x.up = s.up AND x.pos = xor(q.pos >> s.up, 1)),
        proofs AS (SELECT g, row, sha256(string_agg(coalesce(digest, ''), '' ORDER BY up)) AS proof FROM sides GROUP BY g, row),
        folds AS (SELECT g, pos AS row, 0 AS up, coalesce(changed, leaf) AS digest FROM placed
          UNION ALL SELECT f.g, f.row, f.up + 1, sha256(CASE WHEN right_side = 1 THEN concat(s.digest, f.digest)
            ELSE concat(f.digest, s.digest) END) FROM folds f JOIN sides s ON s.g = f.g AND s.row = f.row AND s.up = f.up)
        SELECT p.doc_id, p.leaf, q.subroot, t.digest AS root, coalesce(proof, sha256('')) AS proof_sha256,
          f.digest AS folded_root, f.digest = t.digest AS verified
        FROM placed p JOIN groups q ON q.g = p.g JOIN tops t ON t.n = 1
        LEFT JOIN proofs r ON r.g = p.g AND r.row = p.pos
        JOIN (SELECT g, row, arg_max(digest, up) AS digest FROM folds GROUP BY g, row) f ON f.g = p.g AND f.row = p.pos""",
    "op13_fill_middle": r"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, sha256(concat('7:', doc_id)) AS h,
          regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
        drawn AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1,
          CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c3,
          CAST('0x' || h[25:32] AS BIGINT) % 100 AS c4 FROM cut),
        parts AS (SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
            OR contains(text, '<M>') OR c3 >= 100 THEN 'plain' WHEN c4 < 50 THEN 'spm' ELSE 'psm' END AS form,
          array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
          array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM drawn)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
          CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m)
            ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts""",
}
