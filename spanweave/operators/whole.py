"""Mentions, voting, the chain program, pruning, arbitration and rating of whole queries, one row a query, in NumPy.

The same rules as in ``segment``, ``voting`` and ``scoring``, for dictionaries that can be sent to all tasks: a query comes
with its tokens, what its session has chosen and its gold spans, so that no n-gram or mention is stored, dealt out or joined.
Mentions of a batch are flat arrays; what belongs to one of them (candidates, votes, the query's other mentions) is
gathered in runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .voting import BOOST, DP_LIMIT, ZERO, limit, surface_votes

#: Dictionaries and tables of relatedness or votes of at most so many rows are sent.
MOST = 250_000
#: Sums over (query, link) are kept in full arrays of at most so many places, else by sorted keys.
DENSE = 1 << 23


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half up as Spark rounds, by the shortest decimal."""
    scaled = x * 10.0**digits
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4).tolist():
        whole[i] = int(Decimal(repr(float(x[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return whole / 10.0**digits


def runs(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of places: the run each belongs to, and the places."""
    of = np.repeat(np.arange(len(size)), size)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def totals(keys: np.ndarray, weights: np.ndarray | None, asked: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``weights`` (or numbers) of equal ``keys`` below ``size``, at the keys ``asked``."""
    if size <= DENSE:
        return np.bincount(keys, weights, size)[asked]
    if not len(keys):
        return np.zeros(asked.shape)
    known, place = np.unique(keys, return_inverse=True)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, np.bincount(place, weights)[at], 0)


def coded(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Places in ``known``, -1 where not."""
    return pc.fill_null(pc.index_in(values, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many values each list has (null: none), and the values."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


class Known:
    """Dictionary, votes of surfaces, relatedness and corrections as arrays; links and surfaces by number."""

    def __init__(self, dictionary: pa.Table, cands: pa.Table, votes: pa.Table, rel: pa.Table, fixes: pa.Table):
        one = lambda t, c: pa.concat_arrays(t.column(c).chunks or [pa.array([], t.column(c).type)])
        number = lambda t, c: one(t, c).to_numpy(zero_copy_only=False)
        self.surfaces = pc.unique(one(dictionary, "surface"))
        self.links = pc.unique(pa.concat_arrays([one(dictionary, "link"), one(fixes, "link"), one(fixes, "canonical"), one(rel, "e1"), one(rel, "e2"), one(votes, "target")]))
        self.n = max(1, len(self.links))

        def grouped(t: pa.Table, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = coded(one(t, "surface"), self.surfaces)
            by = np.lexsort((*order, s))
            return by, np.searchsorted(s[by], np.arange(len(self.surfaces) + 1))

        by, self.at = grouped(dictionary, number(dictionary, "rank"))
        self.link, self.prob = coded(one(dictionary, "link"), self.links)[by], number(dictionary, "prob")[by]
        by, self.said_at = grouped(votes)
        self.said, self.said_vote = coded(one(votes, "target"), self.links)[by], number(votes, "vote")[by]
        by, self.cand_at = grouped(cands, number(cands, "rank"), -number(cands, "prob"))  # the greatest prior first
        self.cand, self.cand_prob, self.cand_rank = coded(one(cands, "link"), self.links)[by], number(cands, "prob")[by], number(cands, "rank")[by].astype(np.int64)
        where = np.repeat(np.arange(len(self.surfaces)), np.diff(self.cand_at))
        said_by = np.repeat(np.arange(len(self.surfaces)), np.diff(self.said_at))
        order = np.argsort(said_by * self.n + self.said)
        keys, asked = (said_by * self.n + self.said)[order], where * self.n + self.cand
        near = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
        self.own = np.where(keys[near] == asked, self.said_vote[order][near], 0.0) if len(keys) else np.zeros(len(asked))
        self.first = np.full(len(self.surfaces), -1)
        filled = np.flatnonzero(np.diff(self.cand_at))
        if len(filled):
            self.first[filled] = np.minimum.reduceat(self.cand_rank, self.cand_at[filled]) - 1
        width = np.arange(DP_LIMIT)
        has = width < np.minimum(np.diff(self.at), DP_LIMIT)[:, None]
        place = np.where(has, self.at[:-1, None] + width, 0)
        self.chain_link, self.chain_prob = np.where(has, self.link[place], -1), np.where(has, self.prob[place], -1.0)
        self._words()
        self.canonical = np.arange(self.n)
        self.canonical[coded(one(fixes, "link"), self.links)] = coded(one(fixes, "canonical"), self.links)
        e = coded(one(rel, "e1"), self.links) * self.n + coded(one(rel, "e2"), self.links)
        order = np.argsort(e)
        self.rel_key, self.rel_value, self.full = e[order], number(rel, "rel")[order], None
        if self.n**2 <= DENSE:
            self.full = np.zeros(self.n**2)
            self.full[self.rel_key] = self.rel_value

    def _words(self) -> None:
        """Runs of words that surfaces begin with, by number: the next run for each and a word, and the surface each is (-1: none)."""
        words, after, runs_, self.longest = {}, {}, [-1], 0
        for i, surface in enumerate(self.surfaces.to_pylist()):
            at, split = 0, surface.split(" ")
            self.longest = max(self.longest, len(split))
            for w in split:
                step = (at, words.setdefault(w, len(words)))
                if step not in after:
                    after[step] = len(runs_)
                    runs_.append(-1)
                at = after[step]
            runs_[at] = i
        self.words, self.run = pa.array(list(words), pa.string()), np.array(runs_)
        keys = np.array([a * max(1, len(words)) + w for a, w in after], np.int64)
        order = np.argsort(keys)
        self.step_key, self.step_to = keys[order], np.array(list(after.values()), np.int64)[order]

    def step(self, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The runs after ``at`` and a word, -1 where no surface begins so."""
        if not len(self.step_key):
            return np.full(len(at), -1)
        key = at * len(self.words) + word
        near = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
        return np.where((at >= 0) & (word >= 0) & (self.step_key[near] == key), self.step_to[near], -1)

    def rel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Relatedness of links, 0 where unknown."""
        key = a * self.n + b
        if self.full is not None:
            return self.full[key]
        if not len(self.rel_key):
            return np.zeros(key.shape)
        at = np.minimum(np.searchsorted(self.rel_key, key), len(self.rel_key) - 1)
        return np.where(self.rel_key[at] == key, self.rel_value[at], 0.0)


def known(dictionary: DataFrame, rel: DataFrame, fixes: DataFrame, k: int, tau: float) -> Known | None:
    """The tables to send; None if they are too large, or have nulls, or links corrected in two ways."""
    cands = limit(dictionary, k, tau)
    if dictionary.limit(MOST + 1).count() > MOST or rel.limit(MOST + 1).count() > MOST or dictionary.where("surface IS NOT NULL AND (link IS NULL OR prob IS NULL)").limit(1).count():
        return None
    votes, fixes = surface_votes(cands, rel).where("surface IS NOT NULL").limit(MOST + 1).toArrow(), fixes.where("link IS NOT NULL").toArrow()
    if votes.num_rows > MOST or len(pc.unique(fixes.column("link"))) < fixes.num_rows:
        return None
    some = lambda x: x.where("surface IS NOT NULL").select("surface", "rank", "link", "prob").toArrow()
    return Known(some(dictionary), some(cands), votes, rel.toArrow(), fixes)


class _Batch:
    """Mentions of some queries, flat and in order: ``q`` the query, ``s`` the surface, ``old`` the choice so far."""

    def __init__(self, has: Known, batch: pa.RecordBatch, max_n: int | None):
        self.has, self.size = has, batch.num_rows
        self.tokens, words = flat(batch.column("tokens"))
        found = self._found(coded(words, has.words), has.longest if max_n is None else min(max_n, has.longest))
        self.q, self.s, self.position, self.words, self.old = found
        self.m = np.bincount(self.q, minlength=self.size)
        self.at = np.cumsum(self.m) - self.m

    def _found(self, word: np.ndarray, longest: int) -> list[np.ndarray]:
        """As ``segment.ngrams``, ``lookup`` and ``overlap_lists``: lengths from the longest, all places at once.

        Only n-grams of equal length wait for those before them in the query.
        """
        h, q = self.has, np.repeat(np.arange(self.size), self.tokens)
        pos = np.arange(len(q)) - (np.cumsum(self.tokens) - self.tokens)[q]
        rest = self.tokens[q] - pos

        def moved(x: np.ndarray, d: int, none):
            """At each place what stands ``d`` places on in the same query."""
            out, n = np.full(len(x), none, x.dtype), max(0, len(x) - abs(d))
            if d >= 0:
                out[:n] = np.where(rest[:n] > d, x[d:], none)
            else:
                out[-d:] = np.where(pos[-d:] >= -d, x[:n], none)
            return out

        at, surface = np.zeros(len(q), np.int64), {}
        for n in range(1, longest + 1):
            at = h.step(at, moved(word, n - 1, -1))
            surface[n] = np.where(at >= 0, h.run[at], -1)
        by_pos = np.argsort(pos, kind="stable")
        kept, out = {}, []
        for n in range(longest, 0, -1):
            fit = surface[n] >= 0
            for m in range(n + 1, longest + 1):
                for d in range(1 - m, n):
                    if d < 0 or n - m < d:
                        fit &= ~moved(kept[m], d, False)
            if n > 1 and fit.any():
                prior = np.where(fit, h.prob[h.at[np.maximum(surface[n], 0)]], 0.0)
                on = by_pos[fit[by_pos]]
                ends = np.searchsorted(pos[on], np.arange(int(pos[on[-1]]) + 2))
                for t in range(1, len(ends) - 1):
                    i = on[ends[t] : ends[t + 1]]
                    for d in range(1, min(n - 1, t) + 1):
                        fit[i] &= ~(fit[i - d] & (prior[i] < prior[i - d]))
            kept[n], later = fit, np.zeros(len(q), bool)
            for d in range(1, n):
                later |= moved(fit, d, False)
            i = np.flatnonzero(fit)
            out.append((q[i], surface[n][i], pos[i], np.full(len(i), n), np.where(later[i], -1, 0)))
        all_ = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        order = np.argsort(all_[0], kind="stable")
        return [x[order] for x in all_]

    def vote(self, epsilon: float) -> np.ndarray:
        """As ``voting.votes`` and ``choose_epsilon``."""
        h = self.has
        of, at = runs(h.said_at[self.s], np.diff(h.said_at)[self.s])
        by, cand = runs(h.cand_at[self.s], np.diff(h.cand_at)[self.s])
        sums = totals(self.q[of] * h.n + h.said[at], h.said_vote[at], self.q[by] * h.n + h.cand[cand], self.size * h.n)
        votes = np.maximum(sums - h.own[cand], 0.0)
        fit, near = votes >= epsilon, np.flatnonzero(np.abs(votes - epsilon) < 1e-8)
        fit[near] = rounded(votes[near], 9) >= epsilon
        by, cand = (x[fit & (h.cand_prob[cand] > 0)] for x in (by, cand))
        chosen = np.where(h.first[self.s] >= 0, h.first[self.s], self.old)
        first = np.diff(by, prepend=-1) > 0
        chosen[by[first]] = h.cand_rank[cand[first]] - 1
        return chosen

    def chain(self, history: pa.Array, compat: bool) -> np.ndarray:
        """As ``voting.dp_choice`` and ``with_choice``; a query without a history keeps its choices."""
        h, chosen = self.has, self.old.copy()
        n, had = flat(history)
        seen = np.repeat(np.arange(self.size), n) * h.n + had.to_numpy(zero_copy_only=False)
        links, prob = h.chain_link[self.s], h.chain_prob[self.s]
        boost = totals(seen, None, self.q[:, None] * h.n + np.maximum(links, 0), self.size * h.n) > 0
        base, there = prob * np.where(boost, BOOST, 1.0), links >= 0
        live = np.flatnonzero((self.m > 0) & history.is_valid().to_numpy(zero_copy_only=False))
        v, back = np.full((self.size, DP_LIMIT), -1.0), np.zeros(links.shape, np.int8)
        v[live] = np.where(there[self.at[live]], base[self.at[live]], -1.0)
        steps = int(self.m[live].max(initial=0))
        for t in range(1, steps):
            on = live[self.m[live] > t]
            i = self.at[on] + t
            rel = h.rel(np.maximum(links[i], 0)[:, :, None], np.maximum(links[i - 1], 0)[:, None, :])
            y = v[on][:, None, :] * base[i][:, :, None] * rel * 1e15
            whole = np.floor(y)
            scores = np.where(there[i - 1][:, None, :], (whole + (y - whole >= 0.5)) / 1e15, -1.0)
            best = scores.argmax(2)
            top = np.take_along_axis(scores, best[:, :, None], 2)[:, :, 0]
            back[i] = np.where(top > 0, best, 0)
            v[on] = np.where(there[i], np.where(top > 0, top, ZERO), -1.0)
        last = np.where(there[self.at[live] + self.m[live] - 1], np.arange(DP_LIMIT), 0).max(1) if len(live) else live
        end = np.zeros(self.size, np.int64)
        end[live] = np.where(v[live].max(1) > 0, v[live].argmax(1), last)
        for t in range(steps - 1, -1, -1):
            on = live[self.m[live] > t]
            i = self.at[on] + t
            put = np.ones(len(on), bool) if t or not compat else self.m[on] == 1
            chosen[i[put]] = end[on[put]]
            end[on] = back[i, end[on]]
        return chosen

    def prune(self, chosen: np.ndarray, theta: float, compat: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``knowledge.validate`` and ``voting.prune``: choices left, canonical links, and total coherence."""
        h = self.has
        place = h.at[self.s] + np.maximum(chosen, 0)
        link, prob = h.canonical[h.link[place]], h.prob[place]
        act = np.flatnonzero(chosen >= 0)
        n = np.bincount(self.q[act], minlength=self.size)
        begin, q = np.cumsum(n) - n, self.q[act]
        of, other = runs(begin[q], n[q])
        of, other = of[of != other], other[of != other]
        sums = np.bincount(of, h.rel(link[act][of], link[act][other]), len(act))
        coherence = rounded(np.where(n[q] == 1, 1.0, sums / np.maximum(n[q] - 1, 1) + prob[act] / 2), 9)
        keep = coherence > theta
        total = np.bincount(q, np.where(keep, coherence, 0.0), self.size) / np.maximum(n, 1)
        left = chosen.copy()
        left[(self.at[q] + np.arange(len(act)) - begin[q])[~keep] if compat else act[~keep]] = -1
        return left, link, total

    def confidence(self, left: np.ndarray, total: np.ndarray, tokens: np.ndarray, factor: float = 1.3, divisor: float = 2.3) -> np.ndarray:
        """As ``voting.confidence``."""
        return rounded(total * factor + np.bincount(self.q[left >= 0], minlength=self.size) / tokens / divisor, 6)

    def rate(self, left: np.ndarray, link: np.ndarray, batch: pa.RecordBatch) -> list[np.ndarray]:
        """As ``scoring.rate`` and ``rate_gold``: strict, relaxed, wrong and missed, by query."""
        h, count = self.has, lambda q: np.bincount(q, minlength=self.size)
        n, words = flat(batch.column("gold_substring"))
        gold = coded(flat(batch.column("gold_link"))[1], h.links)
        gold = np.where(gold >= 0, h.canonical[gold], -1)
        text, unknown = coded(words, h.surfaces), words.is_null().to_numpy(zero_copy_only=False)
        position, size = (flat(batch.column(f"gold_{c}"))[1].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("position", "word_count"))
        gold_q, act = np.repeat(np.arange(self.size), n), np.flatnonzero(left >= 0)
        of, g = runs((np.cumsum(n) - n)[self.q[act]], n[self.q[act]])
        same = link[act][of] == gold[g]
        hit = np.zeros(len(gold), bool)
        hit[g[same]] = True
        who, first = np.unique(of[same], return_index=True)
        first = g[same][first]
        who, first = who[~unknown[first]], first[~unknown[first]]
        strict = text[first] == self.s[act][who]
        wrong = np.ones(len(act), bool)
        wrong[who] = False
        begin, end = self.position[act], self.position[act] + self.words[act]
        inside = np.zeros(len(gold), bool)
        inside[g[wrong[of] & (begin[of] <= position[g]) & (position[g] + size[g] <= end[of])]] = True
        q = self.q[act]
        return [count(q[who[strict]]), count(q[who[~strict]]), count(q[wrong]), count(gold_q[~hit & ~inside])]


def _combined(batches: Iterator[pa.RecordBatch], has: Known, max_n: int | None, rated: bool, epsilon: float, theta: float, dp_theta: float, compat: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        b = _Batch(has, batch, max_n)
        tokens = np.maximum(b.tokens, 1)
        v, v_link, v_total = b.prune(b.vote(epsilon), theta, compat)
        d, d_link, d_total = b.prune(b.chain(batch.column("history"), compat), dp_theta, compat)
        first = b.confidence(v, v_total, tokens) >= b.confidence(d, d_total, tokens)
        winner = pa.array(np.where(first, "voting", "dynamic").astype(object), pa.string(), mask=b.m == 0)
        counts = [np.zeros(b.size, np.int64)] * 4
        if rated:
            counts = b.rate(np.where(first[b.q], v, d), np.where(first[b.q], v_link, d_link), batch)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), winner, *(pa.array(x.astype(np.int64)) for x in counts)], ["query_id", "winner", "tp_s", "tp_l", "fp", "fn"])


def combined(rows: DataFrame, has: Known, max_n: int | None, rated: bool, epsilon: float, theta: float, dp_theta: float, compat: bool) -> DataFrame:
    """``query_id``, ``winner`` (null without mentions) and counts of ratings of each query.

    ``rows``: ``query_id``, ``tokens``, the numbers of the links in ``history``, and with ``rated`` lists of gold spans in order.
    """
    sent = rows.sparkSession.sparkContext.broadcast(has)
    made = lambda x: _combined(x, sent.value, max_n, rated, epsilon, theta, dp_theta, compat)
    return rows.mapInArrow(made, "query_id bigint, winner string, tp_s bigint, tp_l bigint, fp bigint, fn bigint")


def _links(batches: Iterator[pa.RecordBatch], has: Known, max_n: int | None) -> Iterator[pa.RecordBatch]:
    """The first candidates of mentions that are not demoted, each once a query."""
    for batch in batches:
        b = _Batch(has, batch, max_n)
        on = b.old == 0
        keys = np.unique(b.q[on] * has.n + has.link[has.at[b.s[on]]])
        got = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(keys // has.n, minlength=b.size))], pa.int32()), pa.array(keys % has.n, pa.int32()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("session_id", "at", "query_id")), got], ["session_id", "at", "query_id", "links"])


def _seen(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of sessions; ``held`` are the links of the session that the last batch ended with."""
    session, held = None, np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("session_id")
        empty = ids.is_null().to_numpy(zero_copy_only=False)
        of = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        run = np.cumsum(np.r_[True, (of[1:] != of[:-1]) | (empty[1:] != empty[:-1])]) - 1
        n, values = flat(batch.column("links"))
        row, code = np.repeat(np.arange(len(of)), n), values.to_numpy(zero_copy_only=False).astype(np.int64)
        on = ~empty[row]
        row, code = row[on], code[on]
        if not empty[0] and of[0] == session:
            row, code = np.r_[np.zeros(len(held), np.int64), row], np.r_[held, code]
        _, first = np.unique(run[row] * size + code, return_index=True)
        row, code = row[first], code[first]
        end = np.r_[np.flatnonzero(np.diff(run)) + 1, len(of)][run[row]]
        which, at = runs(row, end - row)
        order = np.argsort(at, kind="stable")
        got = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(at, minlength=len(of)))], pa.int32()), pa.array(code[which][order], pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), got], ["query_id", "history"])
        session, held = None if empty[-1] else of[-1], code[run[row] == run[-1]]


def history(orders: DataFrame, has: Known, max_n: int | None) -> DataFrame:
    """``query_id`` and ``history``, the numbers of the links that the segmentations of this and earlier queries of the session have chosen.

    ``orders``: ``session_id``, ``at``, ``query_id`` (a session's queries come in the order of both) and ``tokens``.  Each row is dealt out once, by its
    session, with links for tokens.
    """
    spark, size = orders.sparkSession, has.n
    n, sent = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.broadcast(has)
    kinds = orders.select("session_id", "at", "query_id").schema.add("links", ArrayType(IntegerType()))
    put = orders.select("session_id", "at", "query_id", "tokens").mapInArrow(lambda x: _links(x, sent.value, max_n), kinds)
    put = put.repartition(n, "session_id").sortWithinPartitions("session_id", "at", "query_id").select("session_id", "query_id", "links")
    return put.mapInArrow(lambda x: _seen(x, size), "query_id bigint, history array<int>")
