"""Batch forms of the live rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segflow.functions import text as x
from segflow.operators import captions, lines
from segflow.operators.joins import asof, join_small
from segflow.operators.lines import DECODE_LAG_S
from segflow.operators.ordered import number, ordered, total
from segflow.operators.spacing import throttle
from segflow.plans import inputs as I
from segflow.plans.registry import Tables, query

HOUR_US = 3_600_000_000


@query(
    "k1_backlog",
    f"""WITH {I.STREAM} SELECT stream_id, at_us // {HOUR_US} AS tick, sum(round_even(value, 0)::BIGINT)::BIGINT AS written, count(*) AS chunks,
  greatest(sum(round_even(value, 0)::BIGINT) - 60, 0)::BIGINT AS dropped FROM stream GROUP BY ALL""",
)
def backlog(t: Tables) -> DataFrame:
    """Samples written and dropped per stream and drain tick."""
    rows = I.stream(t).withColumn("samples", F.rint("value").cast("long"))
    return lines.backlog(rows, ["stream_id"], F.floor(F.col("at_us") / F.lit(HOUR_US)), "samples", 60)


_M = 60_000_000
_SEG = dict(frame=30 * _M, min_silence=12 * 60 * _M, min_speech=60 * _M, max_speech=24 * 60 * _M)


@query(
    "k2_speech_segments",
    f"""WITH {I.STREAM}, s AS (SELECT stream_id, at_us, CASE WHEN at_us - lag(at_us) OVER w >= {_SEG['min_silence'] + _SEG['frame']} OR lag(at_us) OVER w IS NULL THEN 1 ELSE 0 END AS cut
  FROM stream WHERE score >= 0.05 WINDOW w AS (PARTITION BY stream_id ORDER BY at_us, event_id)),
g AS (SELECT stream_id, at_us, sum(cut) OVER (PARTITION BY stream_id ORDER BY at_us)::BIGINT AS segment FROM s),
b AS (SELECT stream_id, segment, min(at_us) AS s, max(at_us) + {_SEG['frame']} AS e FROM g GROUP BY ALL HAVING max(at_us) + {_SEG['frame']} - min(at_us) >= {_SEG['min_speech']})
SELECT stream_id, segment, i AS piece, s + i * {_SEG['max_speech']} AS "start", least(s + (i + 1) * {_SEG['max_speech']}, e) AS "end" FROM b, unnest(range(0, (e - s - 1) // {_SEG['max_speech']} + 1)) u(i)""",
)
def speech_segments(t: Tables) -> DataFrame:
    rows = ordered(I.stream(t), ["stream_id"], ["at_us", "event_id"])
    return lines.speech_segments(rows, "at_us", "score", 0.05, **_SEG)


_ADMIT = f"""{I.FRAMES}, admit AS (SELECT *, value >= 100 OR coalesce(max((value >= 100)::INT) OVER (PARTITION BY stream_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), 0) = 1 AS admitted,
  round_even(value, 0)::BIGINT AS ms FROM frames)"""


def gated(t: Tables) -> DataFrame:
    chunks = I.frames(t).withColumns({"active": F.col("value") >= 100, "ms": F.rint("value").cast("long")})
    return lines.admitted(chunks, ["stream_id"], "frame", "active")


@query("k3_gating", f"WITH {_ADMIT} SELECT stream_id, frame, admitted FROM admit")
def gating(t: Tables) -> DataFrame:
    return gated(t).select("stream_id", "frame", "admitted")


@query(
    "k4_sessions",
    f"""WITH {_ADMIT}, c AS (SELECT *, sum(CASE WHEN admitted THEN ms ELSE 0 END) OVER w AS audio_clock, sum(CASE WHEN admitted THEN 0 ELSE ms END) OVER w AS skipped FROM admit WINDOW w AS (PARTITION BY stream_id ORDER BY frame)),
r AS (SELECT *, (skipped - coalesce(lag(skipped) OVER (PARTITION BY stream_id ORDER BY frame), 0) >= 150)::INT AS reset FROM c WHERE admitted)
SELECT stream_id, frame, audio_clock::BIGINT AS audio_clock, sum(reset) OVER (PARTITION BY stream_id ORDER BY frame)::BIGINT AS session FROM r""",
)
def sessions(t: Tables) -> DataFrame:
    """Audio clock over admitted chunks and the sessions cut by long skips."""
    rows = ordered(gated(t), ["stream_id"], ["frame"])
    return lines.audio_clock(rows, "ms", 150).rows().select("stream_id", "frame", "audio_clock", "session")


_RULES = (12 * HOUR_US, 6 * HOUR_US, 40 * HOUR_US)


def endpointed(t: Tables):
    spoken = F.col("event_type").isin("click", "view", "purchase").alias("spoken")
    rows = I.stream(t).select("stream_id", "at_us", "event_id", spoken)
    return lines.endpointed(ordered(rows, ["stream_id"], ["at_us", "event_id"]), "at_us", "spoken", *_RULES)


@query(
    "k5_line_endpoints",
    f"""WITH {I.STREAM}, s AS (SELECT stream_id, list_reduce(list([at_us, (event_type IN ('click', 'view', 'purchase'))::BIGINT] ORDER BY at_us, event_id), lambda a, v:
  CASE WHEN len(a) = 0 OR v[1] - a[2] >= {_RULES[0]} OR (a[3] = 1 AND v[1] - a[2] >= {_RULES[1]}) OR v[1] - a[1] >= {_RULES[2]} THEN list_concat([v[1], v[1], v[2]], list_append(a[4:], v[1]))
       ELSE list_concat([a[1], v[1], greatest(a[3], v[2])], a[4:]) END, []::BIGINT[])[4:] AS starts FROM stream GROUP BY stream_id),
l AS (SELECT st.stream_id, st.at_us, len(list_filter(starts, lambda b: b <= st.at_us)) AS line FROM stream st JOIN s USING (stream_id))
SELECT stream_id, line, min(at_us) AS "start", max(at_us) AS "end", count(*) AS updates FROM l GROUP BY ALL""",
)
def line_endpoints(t: Tables) -> DataFrame:
    return lines.line_spans(endpointed(t), "at_us")


@query(
    "j4_asof_count",
    f"""WITH {I.STREAM}, stamps AS (SELECT stream_id, at_us, count(*) OVER (PARTITION BY stream_id ORDER BY at_us) AS words FROM stream WHERE event_type = 'error')
SELECT c.stream_id, c.event_id, c.at_us + {HOUR_US} AS at_us, coalesce(s.words, 0) AS words FROM stream c ASOF LEFT JOIN stamps s ON c.stream_id = s.stream_id AND c.at_us + {HOUR_US} >= s.at_us WHERE c.event_type = 'click'""",
)
def asof_count(t: Tables) -> DataFrame:
    """Word count known one decode lag after each change."""
    stamps = ordered(I.stream(t).where("event_type = 'error'"), ["stream_id"], ["at_us", "event_id"]).scan(words=number()).rows()
    changes = I.stream(t).where("event_type = 'click'").select("stream_id", (F.col("at_us") + HOUR_US).alias("at_us"), "event_id")
    return asof(changes, stamps.select("stream_id", "at_us", "words"), ["stream_id"], "at_us", "words", F.lit(0), "event_id")


@query(
    "k9_count_changes",
    f"""WITH {I.STREAM}, w AS (SELECT stream_id, event_id, at_us, floor(value / 40)::BIGINT AS words, lag(floor(value / 40)::BIGINT, 1, 0::BIGINT) OVER (PARTITION BY stream_id ORDER BY at_us, event_id) AS before FROM stream)
SELECT stream_id, event_id, at_us, words FROM w WHERE words <> before""",
)
def count_changes(t: Tables) -> DataFrame:
    rows = I.stream(t).select("stream_id", "event_id", "at_us", F.floor(F.col("value") / 40).alias("words"))
    return lines.count_changes(ordered(rows, ["stream_id"], ["at_us", "event_id"]), "words").rows()


_CODE = "list_position(['click', 'view', 'error', 'purchase', 'signup'], event_type)"


@query(
    "k10_partial_throttle",
    f"""WITH {I.STREAM}, s AS (SELECT stream_id, list_reduce(list([at_us, {_CODE}] ORDER BY at_us, event_id), lambda a, v:
  CASE WHEN len(a) = 0 OR (v[2] <> a[-1] AND v[1] - a[-2] >= {12 * HOUR_US}) THEN list_concat(a, v) ELSE a END, []::BIGINT[]) AS l FROM stream GROUP BY stream_id)
SELECT stream_id, l[2 * i + 1] AS at_us, ['click', 'view', 'error', 'purchase', 'signup'][l[2 * i + 2]] AS event_type FROM s, unnest(range(0, len(l) // 2)) u(i)""",
)
def partial_throttle(t: Tables) -> DataFrame:
    """Redraws: the text differs from the last one shown and enough time has passed."""
    texts = I.stream(t).select("stream_id", "at_us", "event_id", "event_type")
    rows = throttle(ordered(texts, ["stream_id"], ["at_us", "event_id"]), "at_us", "event_type", 12 * HOUR_US)
    return rows.where(F.col("kept")).rows().select("stream_id", "at_us", "event_type")


# -- caption lines: conversations as recogniser output ------------------------------------

STEP_WORDS, WORD_S = 6, 0.3


def recogniser_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Partial texts every six words and a final text per turn, with changes inside some turns.

    Turns are 1000 s apart on the audio clock; a turn's words are never cut.
    """
    words = t.conversations.select(
        F.col("conv_id").alias("stream_id"), (F.col("turn") * 1000.0).alias("begun"), "turn", x.split_words("text").alias("w")
    ).where(F.size("w") > 0)
    steps = F.sequence(F.lit(1), F.ceil(F.size("w") / F.lit(STEP_WORDS)).cast("int"))
    cut = words.select("*", F.explode(F.concat(steps, F.array(F.lit(-1)))).alias("step"))
    upto = F.least(F.when(F.col("step") > 0, F.col("step") * STEP_WORDS).otherwise(F.size("w")), F.size("w"))
    last = F.col("step") < 0
    body = F.array_join(F.slice("w", F.lit(1), upto), " ")
    clock = F.col("begun") + upto * F.lit(WORD_S) + F.when(last, 1.0).otherwise(0.0)
    updates = cut.select(
        "stream_id",
        F.when(last, 1 << 30).otherwise(F.col("step")).alias("seq"),
        clock.alias("clock_s"),
        F.when(last, "").otherwise(body).alias("partial"),
        F.when(last, body).alias("final"),
        F.when(last, 0.9).otherwise(0.5).alias("confidence"),
    )
    # a change after every ninth word of every second turn, detected one second later
    points = F.sequence(F.lit(1), F.greatest(F.floor(F.size("w") / 9).cast("int"), F.lit(1)))
    changes = words.where("turn % 2 = 0").select("stream_id", "begun", F.explode(points).alias("k"))
    at = F.col("begun") + F.col("k") * F.lit(9 * WORD_S)
    return updates, changes.select("stream_id", at.alias("time_s"), (at + 1.0).alias("detected_at_s"))


# The same rule over the words of each turn: every sixth word a partial, so clocks and counts come from the numbers.
_TURNS = f"""cw AS (SELECT conv_id, turn, list_filter(string_split_regex(text, chr(92) || chr(115) || chr(43)), lambda v: length(v) > 0) AS w FROM conversations),
cu AS (SELECT conv_id AS sid, turn, w, len(w) AS n, turn * 1000.0::DOUBLE AS b, lag(w) OVER q AS pw, row_number() OVER q AS u, count(*) OVER (PARTITION BY conv_id) AS us FROM cw WHERE len(w) > 0 WINDOW q AS (PARTITION BY conv_id ORDER BY turn)),
ct AS (SELECT *, coalesce(list_max(list_filter(range(1, 6), lambda k: k <= n AND k <= len(pw) AND list_transform(pw[-k:], lambda v: lower(v)) = list_transform(w[1:k], lambda v: lower(v)))), 0) AS again,
  b + n * {WORD_S}::DOUBLE + 1.0 AS fin, list_transform(range(1, (n + {STEP_WORDS - 1}) // {STEP_WORDS} + 1), lambda j: least({STEP_WORDS} * j, n)) AS steps FROM cu),
cs AS (SELECT *, coalesce(lag(fin) OVER (PARTITION BY sid ORDER BY turn), 0.0)::DOUBLE AS begun FROM ct),
ca AS (SELECT *, b + k * {9 * WORD_S!r}::DOUBLE AS chg FROM cs, unnest(range(1, greatest(n // 9, 1) + 1)) r(k) WHERE turn % 2 = 0),
ch AS (SELECT *, list_min(list_filter(steps, lambda m: b + m * {WORD_S}::DOUBLE >= chg + 1.0)) AS mres, list_max(list_filter(steps, lambda m: b + m * {WORD_S}::DOUBLE <= chg + {DECODE_LAG_S}::DOUBLE)) AS heard FROM ca)"""


def _cuts_sql(ended: str) -> str:
    """Applied cuts and the rests of utterances; ``ended`` tells which utterances have a final."""
    return f"""{_TURNS}, cc AS (SELECT *, least(coalesce(heard - again, 0), coalesce(mres, n) - again) AS cut FROM ch WHERE chg + 1.0 <= fin OR NOT ({ended})),
cp AS (SELECT *, coalesce(max(cut) OVER (PARTITION BY sid, turn ORDER BY chg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM cc),
cl AS (SELECT *, coalesce(lag(chg) OVER (PARTITION BY sid, turn ORDER BY chg), begun) AS start, row_number() OVER (PARTITION BY sid, turn ORDER BY chg) - 1 AS part FROM cp WHERE cut > low),
cx AS (SELECT sid, turn, max(cut) AS shown, max(chg) AS lastat, count(*) AS parts FROM cl GROUP BY ALL),
cf AS (SELECT cs.*, coalesce(shown, 0) AS low, coalesce(lastat, begun) AS start, coalesce(parts, 0) AS part, CASE WHEN {ended} THEN fin ELSE b + n * {WORD_S}::DOUBLE END AS stop FROM cs LEFT JOIN cx USING (sid, turn))"""


_REST = "SELECT sid AS stream_id, round(stop, 6) AS emitted_s, part, array_to_string(w[again + low + 1:], ' ') AS text, round(start, 6) AS start_s, round(greatest(stop - start, 0), 6) AS duration_s"
_EMITTED = f"CASE WHEN mres IS NULL THEN fin ELSE b + mres * {WORD_S}::DOUBLE END"


def caption_rows(t: Tables) -> DataFrame:
    return captions.utterances(*recogniser_rows(t))


def caption_texts(t: Tables, cause: str) -> DataFrame:
    updates, changes = recogniser_rows(t)
    return captions.caption_lines(captions.utterances(updates, changes), updates, display=False).where(F.col("cause") == cause)


@query(
    "k7_change_splits",
    f"""WITH {_cuts_sql('true')} SELECT sid AS stream_id, round({_EMITTED}, 6) AS emitted_s, part, array_to_string(w[again + low + 1:again + cut], ' ') AS text, round(start, 6) AS start_s, round(chg - start, 6) AS duration_s,
  CASE WHEN mres IS NULL THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence, 'change' AS cause, round(chg, 6) AS change_s FROM cl""",
)
def change_splits(t: Tables) -> DataFrame:
    """Lines cut at speaker changes, with duration and confidence (text before display formatting)."""
    return caption_texts(t, "change")


@query("k8_final_lines", f"WITH {_cuts_sql('true')} {_REST}, 0.9::DOUBLE AS confidence, 'final' AS cause FROM cf WHERE n - again > low")
def final_lines(t: Tables) -> DataFrame:
    """Lines emitted when an utterance ends: only the words not shown by a split."""
    return caption_texts(t, "final").drop("change_s")


@query(
    "k8_words_conserved",
    f"WITH w AS (SELECT conv_id, turn, {'list_filter(string_split_regex(text, chr(92) || chr(115) || chr(43)), lambda v: length(v) > 0)'} AS w FROM conversations) SELECT conv_id AS stream_id, count(*) FILTER (len(w) > 0) AS utterances, sum(len(w))::BIGINT AS words FROM w GROUP BY 1 HAVING utterances > 0",
)
def words_conserved(t: Tables) -> DataFrame:
    """Words of all lines plus the replayed ones: every word appears exactly once."""
    shown = F.aggregate("lines", F.lit(0), lambda a, l: a + l["high"] - l["low"])
    return caption_rows(t).groupBy("stream_id").agg(F.count(F.lit(1)).alias("utterances"), F.sum(shown + F.col("replayed")).cast("long").alias("words"))


@query("k11_flush", f"WITH {_cuts_sql('u < us')} {_REST}, 0.5::DOUBLE AS confidence FROM cf WHERE u = us AND n - again > low")
def flushed_lines(t: Tables) -> DataFrame:
    """Sessions cut off before their last final: the open line is closed with the last partial text."""
    updates, changes = recogniser_rows(t)
    ends = updates.where("final is not null").groupBy("stream_id").agg(F.max("clock_s").alias("end_s"))
    open_ended = join_small(updates, ends, ["stream_id"]).where("final is null or clock_s < end_s").drop("end_s")
    rows = captions.utterances(open_ended, changes)
    return captions.caption_lines(rows, open_ended, display=False).where("cause = 'flush'").drop("cause", "change_s")


@query(
    "k12_session_counts",
    f"""WITH {_cuts_sql('true')}, k AS (SELECT sid, count(*) AS splits FROM cl GROUP BY 1), r AS (SELECT sid, count(*) FILTER (n - again > low) AS rests FROM cf GROUP BY 1),
l AS (SELECT sid, count(*) AS late FROM ch WHERE chg + 1.0 > fin AND chg <= fin AND u < us GROUP BY 1)
SELECT sid AS stream_id, coalesce(splits, 0) AS splits, coalesce(late, 0) AS late_changes, coalesce(splits, 0) + rests AS lines FROM r LEFT JOIN k USING (sid) LEFT JOIN l USING (sid)""",
)
def session_counts(t: Tables) -> DataFrame:
    return captions.session_counts(caption_rows(t))


@query(
    "k12_change_latency",
    f"WITH {_cuts_sql('true')}, e AS (SELECT sid, {_EMITTED} - chg AS late FROM cl) SELECT sid AS stream_id, count(*) AS changes, round(avg(late), 6) AS mean_s, round(max(late), 6) AS max_s FROM e GROUP BY 1",
)
def change_latency(t: Tables) -> DataFrame:
    """Seconds from each applied change to its line, per stream."""
    cuts = caption_rows(t).select("stream_id", F.explode("lines").alias("l")).select("stream_id", "l.*").where("cause = 'change'")
    late = F.col("emitted_s") - F.col("change_s")
    return cuts.groupBy("stream_id").agg(F.count(F.lit(1)).alias("changes"), F.avg(late).alias("mean_s"), F.max(late).alias("max_s"))
