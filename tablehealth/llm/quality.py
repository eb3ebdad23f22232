"""Quality rules: base rules per document, verdicts per host with an empirical beta prior.

``measure`` takes one pass over the texts; only counts leave it.  Failures are summed by
host (partial sums before the shuffle, so a host with a third of all rows is no burden),
each host's failure rate is shrunk towards the rate of all hosts by a beta prior fitted
to the hosts themselves, and a host whose shrunk rate passes ``host_limit`` is rejected
with all its documents.  Rejected hosts are joined back as a small table.

Null or empty texts have no words and fail; a null source has no host, so only the base
rules judge its documents.  Repeated rows are judged alike, an empty table gives no rows,
and columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehealth.llm import common, scan

#: Fixed by the contract.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WORDS = 5
SYMBOLS = b"#*$%&|<>"

#: A host is rejected when more than this share of its documents fails, after shrinking.
HOST_LIMIT = 0.5

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` within each [offsets[i], offsets[i + 1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _owner(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, positions, "right") - 1


def _again(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with an owner: is an equal item of this owner earlier; is there any other."""
    key = scan.mix(hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    earlier, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    earlier[order] = same[:-1]
    any_[order] = same[:-1] | same[1:]
    return earlier, any_


def measures(s: scan.Slice) -> dict[str, np.ndarray]:
    """The counts of every document of a slice."""
    words = s.words()
    inside = np.zeros(len(s.data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1  # where words touch, at a document's end, the two cancel
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = {"n_words": words.counts, "word_chars": _sums(inside & ((s.data & 0xC0) != 0x80), s.offsets), "n_symbols": _sums(_SYMBOL[s.data], s.offsets)}

    # lines: from a document's start or behind a newline, to the next newline or the document's end
    newline = np.flatnonzero(s.data == 10)
    filled = s.offsets[:-1][np.diff(s.offsets) > 0]
    start = np.union1d(newline + 1, filled)
    start = start[start < len(s.data)]
    stop = np.minimum(
        np.append(newline, len(s.data))[np.searchsorted(newline, start)],
        s.offsets[np.minimum(_owner(start, s.offsets) + 1, len(s))],
    )
    worded = np.searchsorted(words.start, stop) > np.searchsorted(words.start, start)
    start, stop = start[worded], stop[worded]
    owner = _owner(start, s.offsets)
    earlier, _ = _again(scan.string_hashes(s.data, start, stop), owner)
    out["n_dup_lines"] = np.bincount(owner[earlier], minlength=len(s))

    # words in windows that occur twice or more in their document
    whole = np.flatnonzero(scan.whole_windows(words.offsets, REPEAT_WORDS, len(words)))
    windows = scan.folded_windows(words.hashes(), REPEAT_WORDS)[whole]
    _, twice = _again(windows, _owner(whole, words.offsets))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, whole[twice], 1)
    np.add.at(cover, whole[twice] + REPEAT_WORDS, -1)
    out["n_repeat_words"] = _sums(np.cumsum(cover[:-1]) > 0, words.offsets)
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, the row's identity and the counts, one row for each row of ``docs``."""

    def rows(batch):
        for s in scan.slices(batch["text"]):
            same = batch.slice(s.first, len(s))
            yield {"doc_id": same["doc_id"], "source": same["source"], "_doc": same["_doc"], "_key": same["_key"]} | measures(s)

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), *common.row_id(), F.col("text").cast("string"))
    return common.arrow_map(narrow, rows, f"doc_id long, source string, _doc long, _key long, {MEASURES}").withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_rates(judged: DataFrame) -> DataFrame:
    """source, n, failed, shrunk_rate: one row per host.

    The prior's mean is the failure rate of all documents; its strength comes from the
    spread of the hosts' rates beyond what their sizes explain (method of moments).
    """
    hosts = judged.where(F.col("source").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    hosts = common.stage(hosts, "hosts")
    rate = F.col("failed") / F.col("n")
    total = hosts.agg(F.sum("n").alias("all"), F.sum("failed").alias("bad"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum(F.col("n") * rate * rate).alias("second")).first()
    alpha, beta = beta_prior(total["all"] or 0, total["bad"] or 0, total["hosts"], float(total["squares"] or 0), total["second"] or 0.0)
    return hosts.withColumn("shrunk_rate", (F.col("failed") + alpha) / (F.col("n") + alpha + beta))


def beta_prior(n: int, failed: int, hosts: int, squares: float, second: float, weakest: float = 2.0, strongest: float = 1e6) -> tuple[float, float]:
    """Alpha and beta by moments of the hosts' rates, weighted by their sizes.

    ``squares`` is the sum of squared sizes, ``second`` the sum of size * rate ** 2.  With q =
    mean * (1 - mean) and v the variance between hosts, a host of n_i documents has a rate of
    variance v + (q - v) / n_i, and the weighted squares about the common mean add up to
    v * (n - squares / n) + (hosts - 1) * (q - v) on average, however uneven the sizes are.
    Without evidence of a spread (a single host, hosts of one document each) the prior is as
    strong as it may be.
    """
    if not n:
        return 1.0, 1.0
    mean = min(max(failed / n, 1e-6), 1 - 1e-6)
    q, spread = mean * (1 - mean), max(0.0, second - n * (failed / n) ** 2)
    weight = n - squares / n - (hosts - 1)
    between = (spread - (hosts - 1) * q) / weight if weight > 1e-9 * n else 0.0
    strength = strongest if between <= 0 else min(max(q / between - 1, weakest), strongest)
    return mean * strength, (1 - mean) * strength


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """Counts, base_failed and kept for each row of ``docs``, with its identity."""
    judged = common.stage(measure(docs), "measures")
    bad = common.stage(host_rates(judged).where(F.col("shrunk_rate") > host_limit).select(F.col("source").alias("_bad")), "bad-hosts")
    return judged.join(common.small(bad), F.col("source") == F.col("_bad"), "left").withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_bad")


def keep(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    out = common.stage(judge(docs, host_limit).where(~F.col("kept")).select(*common.ROW).distinct(), "rejected")
    return common.decoded(common.coded(docs).join(common.small(out), common.ROW, "left_anti"), docs)
