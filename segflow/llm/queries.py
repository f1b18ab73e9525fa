"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return keep


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@_query("op1_template_removal")
def template_removal(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import pages

    return pages.main_text(_table(spark, folder, "pages"))


@_query("op2_minhash_near_dedup")
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import icws

    return icws.near_classes(_table(spark, folder, "documents"))


@_query("op3_syncmer_fingerprints")
def syncmer_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import syncmers

    return syncmers.fingerprints(_table(spark, folder, "documents"))


_BYTES_SQL = r"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, hash(substring(x, 2 * i + 1, 400)) AS h, md5_number(substring(x, 2 * i + 1, 400)) AS m FROM b, unnest(range(0, n - 199)) r(i)),
many AS (SELECT h, m FROM win GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i > lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS fresh FROM win JOIN many USING (h, m)),
run AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + 200 AS z FROM run GROUP BY ALL),
cut AS (SELECT doc_id, k, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM span),
part AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS tail, string_agg(substring(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY k) AS t FROM cut JOIN b USING (doc_id) GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, '') || substring(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN part USING (doc_id)
"""


@_query("op4_suffix_dedup", _BYTES_SQL)
def suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import suffixes

    return suffixes.suffix_digest(_table(spark, folder, "documents"), 200)


_WORDS_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM w, unnest(range(1, len(w) - 48)) r(i)),
low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
hit AS (SELECT DISTINCT win.doc_id, i FROM win JOIN low USING (h) WHERE low < win.doc_id),
word AS (SELECT doc_id, j, w[j] AS v FROM w, unnest(range(1, len(w) + 1)) r(j)),
gone AS (SELECT word.doc_id, j, v, coalesce(max(i) OVER (PARTITION BY word.doc_id ORDER BY j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL, false) AS out FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND i = j),
kept AS (SELECT doc_id, count(*) FILTER (out) AS n_removed, coalesce(string_agg(v, ' ' ORDER BY j) FILTER (NOT out), '') AS t FROM gone GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


@_query("op9_factor_dedup", _WORDS_SQL)
def factor_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import factors

    return factors.factor_digest(_table(spark, folder, "documents"), 50)


@_query("op5_simhash_decontamination")
def simhash_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import simhash

    return simhash.leaks(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op6_neighbour_toxicity")
def neighbour_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import neighbours

    return neighbours.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query("op7_rans_tokens")
def rans_tokens(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import rans

    return rans.round_trip(_table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), 2)


@_query("op8_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import packing

    return packing.pack(_table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), 1024, 2)


@_query("op10_sharding")
def sharding_slots(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import sharding

    return sharding.shard(_table(spark, folder, "documents"), 16)


_PHRASES_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda v: v <> '') AS w FROM p),
i AS (SELECT lang, w, row_number() OVER () AS piece FROM w),
u AS (SELECT lang, piece, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM i),
g AS (SELECT lang, v AS a, lead(v, 1) OVER o AS b, lead(v, 2) OVER o AS c, lead(v, 3) OVER o AS d, lead(v, 4) OVER o AS e FROM u WINDOW o AS (PARTITION BY piece ORDER BY i)),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, 1 AS m, a AS phrase FROM g UNION ALL SELECT lang, 2, a || ' ' || b FROM g UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM g
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM g UNION ALL SELECT lang, 5, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e FROM g) WHERE phrase IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
often AS MATERIALIZED (SELECT lang || ' ' || phrase AS key, * FROM f WHERE f >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM often WHERE m > 1),
cut AS (SELECT lang, phrase, c.f AS a, k, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM c, unnest(range(1, m)) r(k)),
scored AS (SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN often x ON x.key = cut.lang || ' ' || head JOIN often y ON y.key = cut.lang || ' ' || rest JOIN n ON n.lang = cut.lang),
weak AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS longer FROM c, unnest(range(2, m)) a(s), unnest(range(1, m - s + 2)) b(i) GROUP BY ALL),
kept AS (SELECT weak.* FROM weak LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000
"""


@_query("op11_phrase_collocations", _PHRASES_SQL)
def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import collocations

    return collocations.collocations(_table(spark, folder, "documents"), 100, 2000)


_NEAREST_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INT AS rank, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5
"""


@_query("op12_branch_bound_search", _NEAREST_SQL)
def branch_bound_search(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import bounded_search

    return bounded_search.top_scores(_table(spark, folder, "embeddings"), 50, 5)


_SPELLINGS_SQL = r"""
WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
c AS (SELECT run, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x, count(*) AS n FROM run WHERE length(run) >= 6 GROUP BY ALL),
b AS (SELECT run, n, flatten(list_transform(range(0, length(x) // 2), lambda i: list_transform(range(0, 8), lambda j: ((('0x' || substr(x, 2 * i + 1, 2))::BIGINT >> j) & 1)))) AS b FROM c),
h AS (SELECT run, n, xor(list_reduce(b, lambda s, t: xor(s >> 1, 3988292384 * (xor(s, t) & 1)), 4294967295), 4294967295) AS h FROM b),
e AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT DISTINCT word, i, left(word, i - 1) || substr(word, i + 1) AS d FROM w, unnest(range(1, length(word) + 1)) r(i)),
near AS (SELECT a.word, z.word AS other FROM d a JOIN d z ON a.i = z.i AND a.d = z.d AND a.word <> z.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.d = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.d = w.word),
best AS (SELECT near.word, other, w.n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS k FROM near JOIN w ON w.word = other),
form AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 5 * w.n THEN other END AS form, CASE WHEN best.n >= 5 * w.n THEN best.n END AS form_n FROM w LEFT JOIN best ON best.word = w.word AND k = 1),
path AS (SELECT word, word AS here FROM form UNION ALL SELECT path.word, form.form FROM path JOIN form ON form.word = here WHERE form.form IS NOT NULL)
SELECT form.word, form.form, here AS root, form.n, form.n_near, form.form_n FROM form JOIN path ON path.word = form.word JOIN form last ON last.word = here AND last.form IS NULL
"""


@_query("op13_spelling_variants", _SPELLINGS_SQL)
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    from segflow.llm import spellings

    return spellings.variants(_table(spark, folder, "documents"), 6, 5)
