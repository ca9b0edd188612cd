"""The ``opN_`` queries: production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long: small batches keep a Python worker's share of memory small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(documents(spark, sf_dir), k=4, percent=85)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), length=200, keep_bytes=False)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_folder
    from .token_store import read_store, write_store

    folder = new_folder(spark, "token-store")
    write_store(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), folder, end_id=2)
    return read_store(spark, folder).withColumnRenamed("id", "doc_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"), limit=4096)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), end_id=1, window=2048)


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private_data import digest, find

    return digest(find(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.9)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import new_folder
    from .secret_scan import digest, scan

    return digest(scan(documents(spark, sf_dir), new_folder(spark, "secret-ledger")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contained

    return contained(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rate=0.1)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import mine

    return mine(documents(spark, sf_dir), least=30, top=2000)


def op12_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_dedup import remove_repeats

    return remove_repeats(documents(spark, sf_dir), width=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_suffix_dedup, op3_token_store, op4_token_counts, op5_packing, op6_private_data, op7_embedding_dedup, op8_secret_scan,
        op9_language_id, op10_decontamination, op11_phrases, op12_cover_dedup,
    )
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """reach(id, low) AS (SELECT {key}, {key} FROM {table} UNION SELECT l.x, r.low FROM reach r JOIN l ON l.y = r.id WHERE r.low < l.x)"""

#: The other operators' results are beyond SQL (tokenizers, trained models, edit distance) or too slow in it.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS g FROM w),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN c a ON a.doc_id = x JOIN c b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)), {_REACH.format(key='doc_id', table='documents')}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id FROM documents d LEFT JOIN c USING (doc_id) JOIN (SELECT id, min(low) AS low FROM reach GROUP BY 1) ON id = d.doc_id""",
    "op11_phrases": f"""WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, {_LOWERED} AS text FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d)),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
g AS (SELECT lang, m::BIGINT AS m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS m FROM p))),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS x, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
s AS (SELECT c.*, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a + r.a))::BIGINT AS score FROM c JOIN f l ON l.lang = c.lang AND l.m = c.k AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.m = c.m - c.k AND r.phrase = c.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(string_split(phrase, ' ')[j:j + q - 1], ' ') AS phrase, max(a) AS a FROM (SELECT *, unnest(range(1, m - q + 2)) AS j FROM (SELECT *, unnest(range(2, m)) AS q FROM f WHERE m > 2)) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.a IS NULL OR 100 * i.a < 80 * b.a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000""",
    "op12_cover_dedup": """WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS x FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1),
k AS (SELECT w.doc_id, u.i, ws[u.i] AS word, max(r.i) OVER (PARTITION BY w.doc_id ORDER BY u.i) AS last FROM w, unnest(range(1, len(ws) + 1)) AS u(i) LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = u.i),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR last + 19 < i) AS kept, count(*) FILTER (last + 19 >= i) AS gone FROM k GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (doc_id)""",
    "op7_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9 * a.s * b.s), {_REACH.format(key='vec_id', table='embeddings')}
SELECT vec_id, coalesce(k, 0) AS n_links, low AS component_id, vec_id = low AS kept FROM embeddings LEFT JOIN (SELECT x, count(*) AS k FROM l GROUP BY 1) ON x = vec_id JOIN (SELECT id, min(low) AS low FROM reach GROUP BY 1) ON id = vec_id""",
}
