"""Host-level quality rules: document rules, shrunk failure rates of hosts, verdicts (DataFrame functions only).

Each document gets counts from its whole text and a number of broken rules. The host of a document is its
``source``. A host's failure rate is shrunk towards the mean of all hosts by a beta prior fitted to the hosts'
rates (method of moments), so that a host of three documents is not judged on three coin flips. The verdict is
relative to the corpus and weighs how sure the rate is: a host is poor if its rate lies above the corpus rate by
more than ``POOR_Z`` posterior standard deviations, and blocked if it is poor and its rate lies as surely
(``BLOCKED_Z``) above one half.

A document that breaks one soft rule stays on a host in good standing and goes on a poor one; one that breaks two
or more goes anywhere; one that breaks none goes only with a blocked host.

Defined results: a null text has no words (and so fails); a null host is a host of its own; repeated rows
and repeated ids are rows of their own; hosts of equal rates are all in good standing; an empty table gives an
empty table; further columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.rows import without
from tessera.llm.store import bounded_batches, saved

#: Limits of the rules; a rule is broken beyond its limit.
MIN_WORDS, REPEAT_PERCENT = 50, 50
SOFT = {"symbol_percent": 10, "dup_line_percent": 30, "soft_repeat_percent": 30, "shortest_mean_word": 2, "longest_mean_word": 15}
#: Posterior standard deviations by which a host's rate lies above the corpus rate (poor) and above one half (blocked).
POOR_Z, BLOCKED_Z = 0.84, 1.645
#: Hosts that are broadcast at most (a row is 40 bytes at most, next to a host name).
MOST_BROADCAST_HOSTS = 100_000

_SPACE = r"[\x20\x09-\x0D]+"


def _repeat_words(windows: str) -> str:
    """SQL: words in the windows of ``windows`` that occur twice or more in it; 0 for a text without such a window."""
    with_let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    paired = f"array_sort(transform({windows}, (h, i) -> struct(h as h, i as i)))"
    twice = "transform(filter(s, (x, j) -> coalesce(j > 0 and x.h = s[j - 1].h, false) or coalesce(x.h = get(s, j + 1).h, false)), x -> x.i)"
    covered = "cast(aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0, (a, b) -> a + b) as bigint)"
    return f"case when size({windows}) > size(array_distinct({windows})) then {with_let(f'array_sort({with_let(paired, chr(115), twice)})', 'p', covered)} else 0L end"


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long) of the whole text."""
    value = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("_w", F.filter(F.split(value, _SPACE), lambda x: x != "")).withColumn("_l", F.filter(F.split(value, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windows = split.withColumn("_h", F.expr("case when size(_w) > 2 then transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) else cast(array() as array<bigint>) end"))
    return windows.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.array_join("_w", "")).cast("long"),
            "n_symbols": (F.length(value) - F.length(F.regexp_replace(value, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.expr(_repeat_words("_h")),
        }
    ).drop("_w", "_l", "_h")


def failures(counts: DataFrame) -> DataFrame:
    """Adds base_failed and n_soft, the number of soft rules that the document breaks."""
    n, soft = F.col("n_words"), SOFT
    broken = [
        100 * F.col("n_symbols") > soft["symbol_percent"] * n,
        100 * F.col("n_dup_lines") > soft["dup_line_percent"] * F.col("n_lines"),
        100 * F.col("n_repeat_words") > soft["soft_repeat_percent"] * n,
        (F.col("word_chars") < soft["shortest_mean_word"] * n) | (F.col("word_chars") > soft["longest_mean_word"] * n),
    ]
    total = broken[0].cast("int")
    for rule in broken[1:]:
        total = total + rule.cast("int")
    return counts.withColumns({"base_failed": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * n), "n_soft": total})


def host_rates(failed: DataFrame, host: str = "host") -> DataFrame:
    """(host, n_docs, n_failed, host_rate, standing): failure rates of hosts under an empirical beta prior, and verdicts.

    The prior is the beta distribution with the mean and the variance of the hosts' own rates, of a strength of one
    document at least. One row of sums reaches the driver; hosts stay a table.
    """
    hosts = failed.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum((F.col("base_failed") | (F.col("n_soft") > 0)).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    m, v = F.col("m"), F.col("v")
    strength = F.greatest(F.lit(1.0), F.when(v > 1e-12, m * (1 - m) / v - 1).otherwise(F.lit(1e9)))
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), (F.sum("n_failed") / F.sum("n_docs")).alias("p")).select("m", strength.alias("k"), "p").first()
    if prior is None or prior["m"] is None:
        return hosts.withColumns({"host_rate": F.lit(0.0), "standing": F.lit("good")})
    k = F.lit(prior["k"])
    hosts = hosts.withColumn("host_rate", (F.col("n_failed") + F.lit(prior["m"]) * k) / (F.col("n_docs") + k))
    spread = F.sqrt(F.col("host_rate") * (1 - F.col("host_rate")) / (F.col("n_docs") + k + 1))
    poor = F.col("host_rate") - F.lit(prior["p"]) > POOR_Z * spread
    blocked = poor & (F.col("host_rate") - 0.5 > BLOCKED_Z * spread)
    return hosts.withColumn("standing", F.when(blocked, "blocked").when(poor, "poor").otherwise("good"))


def judged(docs: DataFrame, host: str = "source", text: str = "text", broadcast_hosts: int = MOST_BROADCAST_HOSTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, n_soft, host_rate, standing, kept.

    Texts are read once: the counts, a few bytes a document, are kept as a table for the two passes that
    follow. Hosts are broadcast only while they are few; beyond that the join shuffles, on rows that AQE
    can split where a host is hot.
    """
    bounded_batches(docs.sparkSession)
    chosen = docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("text"), F.xxhash64(F.col(host), F.col(text)).alias("row_hash"))
    counts = saved(failures(text_counts(chosen)).drop("text"), "quality")
    rates = saved(host_rates(counts).select(F.col("host").alias("rated"), "host_rate", "standing"), "hosts")
    side = F.broadcast(rates) if rates.count() <= broadcast_hosts else rates.hint("merge")
    kept = ~F.col("base_failed") & (F.col("standing") != "blocked") & ((F.col("n_soft") == 0) | ((F.col("n_soft") == 1) & (F.col("standing") == "good")))
    return counts.join(side, counts["host"].eqNullSafe(side["rated"]), "left").drop("rated").withColumn("kept", kept)


def kept(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    gone = judged(docs, host, text).where(~F.col("kept"))
    return without(docs, gone, {"doc_id": F.col("doc_id"), "row_hash": F.xxhash64(F.col(host), F.col(text))})


ORACLE = r"""
with w as (select row_number() over () as r, doc_id, source as host, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
win as (select r, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
hit as (select r, i from (select r, i, count(*) over (partition by r, w[i], w[i + 1], w[i + 2]) as n from win) where n > 1),
cov as (select r, count(distinct p) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as p from hit) group by r),
c as (select doc_id, host, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words from w left join cov using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    (100 * n_symbols > 10 * n_words)::int + (100 * n_dup_lines > 30 * n_lines)::int + (100 * n_repeat_words > 30 * n_words)::int
    + (word_chars < 2 * n_words or word_chars > 15 * n_words)::int as n_soft from c),
h as (select host, count(*) as n_docs, sum((base_failed or n_soft > 0)::int) as n_failed from f group by host),
p as (select avg(n_failed / n_docs) as m, var_pop(n_failed / n_docs) as v, sum(n_failed) / sum(n_docs) as p from h),
k as (select m, p, greatest(1.0, case when v > 1e-12 then m * (1 - m) / v - 1 else 1e9 end) as k from p),
r as (select host, n_docs, p, k, (n_failed + m * k) / (n_docs + k) as host_rate from h, k),
z as (select *, sqrt(host_rate * (1 - host_rate) / (n_docs + k + 1)) as spread from r),
s as (select host, case when host_rate - p > 0.84 * spread then case when host_rate - 0.5 > 1.645 * spread then 'blocked' else 'poor' end else 'good' end as standing from z)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and standing <> 'blocked' and (n_soft = 0 or (n_soft = 1 and standing = 'good')) as kept, cast(n_soft as int) as n_soft, standing
from f left join s on f.host is not distinct from s.host
"""
