"""Caption text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.functions import text as x
from segflow.operators.lines import display_intervals
from segflow.operators.ordered import lag, ordered
from segflow.plans import inputs as I
from segflow.plans.registry import Tables, query

_NUMBERED = "SELECT p_partkey, p_partkey % 90 + 10 AS a, p_size % 90 + 10 AS b, p_partkey % 7 AS c, p_name FROM part"


def numbered(t: Tables) -> DataFrame:
    """Text with spoken numbers, made from the part keys and names."""
    return t.part.select(
        "p_partkey",
        (F.col("p_partkey") % 90 + 10).cast("string").alias("a"),
        (F.col("p_size") % 90 + 10).cast("string").alias("b"),
        (F.col("p_partkey") % 7).cast("string").alias("c"),
        "p_name",
    )


@query("t1_decimals", f"SELECT p_partkey, 'about ' || a || '.' || b || c || ' ' || p_name AS plain, 'about ' || a || '.' || b || c || p_name AS compat FROM ({_NUMBERED})")
def decimals(t: Tables) -> DataFrame:
    said = F.concat_ws(" ", F.lit("about"), "a", F.lit("point"), "b", "c", "p_name")
    return numbered(t).select("p_partkey", x.decimals(said).alias("plain"), x.decimals(said, compat=True).alias("compat"))


@query(
    "t2_thousands",
    "SELECT o_orderkey, 'order ' || format('{:,}', o_orderkey * 7919 + 1000) || ' of ' || format('{:,}', o_custkey) || ' at 2.12345' AS line FROM orders",
)
def thousands(t: Tables) -> DataFrame:
    said = F.concat(F.lit("order "), F.col("o_orderkey") * 7919 + 1000, F.lit(" of "), F.col("o_custkey"), F.lit(" at 2.12345"))
    return t.orders.select("o_orderkey", x.thousands(said).alias("line"))


@query("t3_digit_pairs", f"SELECT p_partkey, p_name || ' ' || a || b || ' end' AS pair, 'x ' || a || ' ' || b || c AS triple FROM ({_NUMBERED}) WHERE true")
def digit_pairs(t: Tables) -> DataFrame:
    """Two two-digit numbers join; a longer second number keeps them apart."""
    pair = F.concat_ws(" ", "p_name", "a", "b", F.lit("end"))
    triple = F.concat(F.lit("x "), F.col("a"), F.lit(" "), F.col("b"), F.col("c"))
    return numbered(t).select("p_partkey", x.digit_pairs(pair).alias("pair"), x.digit_pairs(triple).alias("triple"))


@query("t4_cued_years", f"SELECT p_partkey, p_name || ' since ' || a || b || ' or ' || a || ' ' || b AS line FROM ({_NUMBERED})")
def cued_years(t: Tables) -> DataFrame:
    said = F.concat_ws(" ", "p_name", F.lit("since"), "a", "b", F.lit("or"), "a", "b")
    return numbered(t).select("p_partkey", x.cued_years(said).alias("line"))


_I = "regexp_replace({}, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])i([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)', '\\1I\\2', 'g')"


@query("t5_capitals", f"SELECT conv_id, turn, md5({_I.format(_I.format('upper(text[1:1]) || text[2:]'))}) AS line FROM conversations")
def capitals(t: Tables) -> DataFrame:
    """Whole turns with the first letter and the pronoun in capitals."""
    return t.conversations.select("conv_id", "turn", F.md5(x.formatted("text", numbers=False)).alias("line"))


@query("t5_formatted_numbers", f"SELECT p_partkey, 'About ' || a || '.' || b || c || ' or ' || format('{{:,}}', p_partkey * 1000 + 1000) || ' then ' || a || b || ' and I' AS line FROM ({_NUMBERED})")
def formatted_numbers(t: Tables) -> DataFrame:
    said = F.concat_ws(
        " ", F.lit("about"), "a", F.lit("point"), "b", "c", F.lit("or"), (F.col("p_partkey") * 1000 + 1000).cast("string"), F.lit("then"), "a", "b", F.lit("and i")
    )
    return numbered(t).select("p_partkey", x.formatted(said).alias("line"))


# Numbers by runs of digits instead of look-around: commas in runs of four or more that follow no point, then two runs
# of two digits with only white space between them and no other number beside them. No text spells a decimal point.
_WORD_CHAR = r"[\p{L}\p{M}\p{N}_]"
_FORMATTED = rf"""d AS (SELECT doc_id, text, regexp_extract_all(text, '\d+|\D+') AS d FROM documents),
n AS (SELECT doc_id, array_to_string(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN regexp_matches(d[i], '^\d{{4,}}$') AND NOT (i > 1 AND right(d[i - 1], 1) = '.')
  THEN ltrim(reverse(regexp_replace(reverse(d[i]), '(\d{{3}})', '\1,', 'g')), ',') ELSE d[i] END), '') AS s FROM d),
t AS (SELECT doc_id, regexp_extract_all(s, '\d+|\s+|[^\d\s]+') AS t FROM n),
p AS (SELECT doc_id, t, list_filter(range(2, len(t)), lambda i: regexp_matches(t[i - 1], '^\d\d$') AND regexp_matches(t[i], '^\s+$') AND regexp_matches(t[i + 1], '^\d\d$')
  AND (i = 2 OR NOT regexp_matches(right(t[i - 2], 1), '{_WORD_CHAR}')) AND (i + 2 > len(t) OR NOT regexp_matches(t[i + 2][1], '{_WORD_CHAR}'))
  AND NOT (i + 3 <= len(t) AND regexp_matches(t[i + 2], '^\s+$') AND regexp_matches(t[i + 3], '^\d'))) AS gone FROM t),
j AS (SELECT doc_id, array_to_string(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN list_contains(gone, i) THEN '' ELSE t[i] END), '') AS s FROM p),
w AS (SELECT doc_id, regexp_extract_all(upper(s[1]) || s[2:], '{_WORD_CHAR}+|[^\p{{L}}\p{{M}}\p{{N}}_]+') AS w FROM j)
SELECT doc_id, md5(array_to_string(list_transform(w, lambda v: CASE WHEN v = 'i' THEN 'I' ELSE v END), '')) AS line FROM w"""


@query("t5_formatted_documents", f"WITH {_FORMATTED}")
def formatted_documents(t: Tables) -> DataFrame:
    """Every document as a caption line, numbers included."""
    return t.documents.select("doc_id", F.md5(x.formatted("text")).alias("line"))


_WORDS = "list_filter(string_split_regex(text, '[\\s\\x0b\\p{Z}\\x1c-\\x1f\\x85]+'), lambda w: w <> '')"


@query(
    "t6_overlap",
    f"""WITH w AS (SELECT conv_id, turn, {_WORDS.replace('text', 'lower(text)')} AS w FROM conversations),
p AS (SELECT *, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM w),
l AS (SELECT conv_id, turn, w, coalesce(b, []) || w[1:turn % 4] AS b FROM p)
SELECT conv_id, turn, coalesce((SELECT max(k) FROM range(1, 6) r(k) WHERE k <= len(w) AND k <= len(b) AND b[len(b) - k + 1:] = w[1:k]), 0)::BIGINT AS overlap, len(w) AS words FROM l""",
)
def overlap(t: Tables) -> DataFrame:
    """Replayed words between turns; a few are appended to the earlier turn to have some."""
    rows = ordered(t.conversations.select("conv_id", "turn", x.split_words("text").alias("w")), ["conv_id"], ["turn"]).scan(before=lag("w"))
    tail = F.slice("w", F.lit(1), (F.col("turn") % 4).cast("int"))
    before = F.concat(F.coalesce("before", F.array().cast("array<string>")), tail)
    return rows.rows().select("conv_id", "turn", x.overlap(x.last_words(before), F.col("w")).alias("overlap"), F.size("w").alias("words"))


WIDTH = 42


@query(
    "t7_caption_chunks",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, flatten(list_transform(w, lambda v: CASE WHEN length(v) > {WIDTH} THEN list_transform(range(0, (length(v) - 1) // {WIDTH} + 1), lambda i: [v[i * {WIDTH} + 1:(i + 1) * {WIDTH}], 'cut']) ELSE [[v, '']] END)) AS p FROM w WHERE len(w) > 0),
l AS (SELECT doc_id, list_reduce(p, lambda a, v: CASE WHEN len(a) = 0 OR v[2] = 'cut' OR length(a[-1]) + 1 + length(v[1]) > {WIDTH}
  THEN list_append(a, v[1]) ELSE list_append(a[:-2], a[-1] || ' ' || v[1]) END, []::VARCHAR[]) AS lines FROM p)
SELECT doc_id, i AS chunk_no, array_to_string(lines[2 * i + 1:2 * i + 2], chr(10)) AS chunk FROM l, unnest(range(0, (len(lines) + 1) // 2)) u(i)""",
)
def caption_chunks(t: Tables) -> DataFrame:
    """Whole documents wrapped to two-line captions of 42 characters, one row per caption."""
    return t.documents.select("doc_id", F.posexplode(x.caption_chunks("text", WIDTH)).alias("chunk_no", "chunk"))


@query(
    "t7_wrapped_turns",
    f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
p AS (SELECT conv_id, turn, flatten(list_transform(w, lambda v: CASE WHEN length(v) > 60 THEN list_transform(range(0, (length(v) - 1) // 60 + 1), lambda i: [v[i * 60 + 1:(i + 1) * 60], 'cut']) ELSE [[v, '']] END)) AS p FROM w WHERE len(w) > 0),
l AS (SELECT conv_id, turn, list_reduce(p, lambda a, v: CASE WHEN len(a) = 0 OR v[2] = 'cut' OR length(a[-1]) + 1 + length(v[1]) > 60
  THEN list_append(a, v[1]) ELSE list_append(a[:-2], a[-1] || ' ' || v[1]) END, []::VARCHAR[]) AS lines FROM p)
SELECT conv_id, turn, i AS chunk_no, array_to_string(lines[2 * i + 1:2 * i + 2], chr(10)) AS chunk FROM l, unnest(range(0, (len(lines) + 1) // 2)) u(i)""",
)
def wrapped_turns(t: Tables) -> DataFrame:
    """Turns wrapped at 60 characters; a blank turn has no chunk."""
    return t.conversations.select("conv_id", "turn", F.posexplode(x.caption_chunks("text", 60)).alias("chunk_no", "chunk"))


@query("t8_display_seconds", f"SELECT conv_id, turn, round(greatest(2.0, least(6.0, 2.0 + 0.2 * greatest(len({_WORDS}), 1))), 6)::DOUBLE AS seconds FROM conversations")
def display_seconds(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", x.display_seconds("text").alias("seconds"))


@query(
    "t9_display_intervals",
    f"""WITH d AS (SELECT conv_id, turn, turn * 1.5::DOUBLE AS shown_at, turn * 1.5::DOUBLE + greatest(2.0, least(6.0, 2.0 + 0.2 * greatest(len({_WORDS}), 1)))::DOUBLE AS own FROM conversations)
SELECT conv_id, turn, shown_at, round(least(own, coalesce(lead(own, 1) OVER w, own), coalesce(lead(shown_at, 2) OVER w, own)), 6) AS hidden_at FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def intervals(t: Tables) -> DataFrame:
    rows = ordered(t.conversations, ["conv_id"], ["turn"])
    shown = display_intervals(rows, F.col("turn") * F.lit(1.5), x.display_seconds("text"))
    return shown.rows().select("conv_id", "turn", "shown_at", "hidden_at")


@query(
    "t10_token_words",
    f"""WITH w AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations),
k AS (SELECT conv_id, turn, i, w[i] AS word, 1 + (length(w[i]) > 3)::INT AS n FROM w, unnest(range(1, len(w) + 1)) u(i)),
s AS (SELECT *, sum(n) OVER o - n AS start_no, sum(n) OVER (PARTITION BY conv_id, turn) AS tokens FROM k WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i))
SELECT conv_id, turn, i - 1 AS word_no, word, round(start_no * 0.25::DOUBLE, 6) AS start_s, round(least(start_no + n, tokens - 1) * 0.25::DOUBLE, 6) AS end_s,
  round(exp(-(CASE WHEN n = 1 THEN (start_no % 7)::DOUBLE / 10 ELSE ((start_no % 7)::DOUBLE / 10 + ((start_no + 1) % 7)::DOUBLE / 10) / 2 END)), 6) AS confidence FROM s""",
)
def token_words(t: Tables) -> DataFrame:
    """Words rebuilt from piece tokens (each word cut after three characters) with times and confidence."""
    mark = F.lit(x.WORD_MARK)
    cut = lambda w: F.when(
        F.length(w) > 3, F.array(F.concat(mark, F.substring(w, 1, 3)), F.substring(w, F.lit(4), F.length(w)))
    ).otherwise(F.array(F.concat(mark, w)))
    tokens = t.conversations.select("conv_id", "turn", "text", F.flatten(F.transform(x.split_words("text"), cut)).alias("tokens"))
    place = F.sequence(F.lit(0), F.size("tokens") - 1)
    arrays = tokens.where(F.size("tokens") > 0).select(
        "conv_id",
        "turn",
        "text",
        "tokens",
        F.transform(place, lambda i: i * F.lit(0.25)).alias("times"),
        F.transform(place, lambda i: -(i % 7) / F.lit(10.0)).alias("logps"),
    )
    words = arrays.select("conv_id", "turn", F.posexplode(x.token_words("tokens", "times", "logps", "text")).alias("word_no", "w"))
    return words.select(
        "conv_id", "turn", "word_no", F.col("w.text").alias("word"), F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"), "w.confidence"
    )


@query(
    "t11_unseen_text",
    """SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 THEN ltrim(text, ' ') ELSE ltrim(text[length(text) // 2 + 1:], ' ') END) AS rest FROM conversations""",
)
def unseen_text(t: Tables) -> DataFrame:
    """Text after the part already shown; every third turn was revised and starts over."""
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    prefix = F.when(F.col("turn") % 3 == 0, F.concat(half, F.lit("#"))).otherwise(half)
    return t.conversations.select("conv_id", "turn", F.md5(x.unseen_text("text", prefix)).alias("rest"))


@query("s6_fingerprint", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def fingerprint(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query(
    "s5_room_category",
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'simulated_rirs/smallroom/' WHEN 1 THEN 'simulated_rirs/mediumroom/' WHEN 2 THEN 'simulated_rirs/largeroom/'
  WHEN 3 THEN 'real_rirs_isotropic_noises/' ELSE 'simulated_rirs/' END || p_brand || '/' || p_partkey || '.wav' AS path FROM part)
SELECT p_partkey, path, CASE p_partkey % 5 WHEN 0 THEN 'smallroom' WHEN 1 THEN 'mediumroom' WHEN 2 THEN 'largeroom' WHEN 3 THEN 'real' ELSE 'other' END AS category FROM p""",
)
def room_category(t: Tables) -> DataFrame:
    from segflow.operators.checks import room_category as category

    folders = F.array(*[F.lit(v) for v in ("simulated_rirs/smallroom", "simulated_rirs/mediumroom", "simulated_rirs/largeroom", "real_rirs_isotropic_noises", "simulated_rirs")])
    path = F.concat(F.get(folders, (F.col("p_partkey") % 5).cast("int")), F.lit("/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".wav"))
    return t.part.select("p_partkey", path.alias("path"), category(path).alias("category"))
