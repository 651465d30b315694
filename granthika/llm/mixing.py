"""Mixing sources to target shares by balanced sampling (problem 9).

The mix is as large as the shares allow: the source that runs out first at its most repeats sets the size. A source
that must give r times its tokens gives every document floor(r) times, and once more with probability r - floor(r), drawn
by the cube method: inclusion probabilities are moved along null vectors of the balancing constraints, here the numbers
of documents and of tokens, until each is 0 or 1. The flight runs in blocks side by side; what a block leaves undecided,
at most two documents, meets the rest of its source in further rounds, until two documents at most are left for the
landing, which takes the choice nearest to the token target.
"""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from granthika.session import settle

from .tokens import Tokenizer

_ROUND = "doc_id long, source string, tokens long, pi double"


def count_tokens(documents: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of the documents with id, source and text."""
    tokenizer = Tokenizer(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(tokenizer.lengths(text)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    rows = documents.where("doc_id is not null and source is not null and text is not null")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(count, "doc_id long, source string, tokens long")


def settle_heads(pi: np.ndarray, sizes: np.ndarray, heads: int, rng: random.Random, eps: float = 1e-9) -> np.ndarray:
    """Decide the ``heads`` largest entries first, each along the null vector that spreads the balance over all smaller ones.

    A large document left for the landing would miss the token target by its size.
    """
    order = np.argsort(-sizes, kind="stable")
    pi = pi.copy()
    for turn in range(heads):
        k, tries = order[turn], 0
        while eps < pi[k] < 1 - eps:
            others = order[turn + 1 :][(pi[order[turn + 1 :]] > eps) & (pi[order[turn + 1 :]] < 1 - eps)]
            if len(others) < 3:
                return pi
            weight = pi[others] * (1 - pi[others])  # entries near their bounds move little
            x = sizes[others]
            w, wx, wxx = weight.sum(), (weight * x).sum(), (weight * x * x).sum()
            det = w * wxx - wx * wx
            tries += 1
            if tries <= 5 and det > 1e-9 * w * wxx:
                a, b = (-wxx + wx * sizes[k]) / det, (wx - w * sizes[k]) / det
            elif wxx > 0:  # both totals can't be held: tokens come before documents
                a, b = 0.0, -sizes[k] / wxx
            else:
                return pi
            at, move = np.append(others, k), np.append(weight * (a + b * x), 1.0)
            p, plus, minus = pi[at], move > 1e-15, move < -1e-15
            up = min(((1 - p[plus]) / move[plus]).min(initial=np.inf), (p[minus] / -move[minus]).min(initial=np.inf))
            down = min((p[plus] / move[plus]).min(initial=np.inf), ((1 - p[minus]) / -move[minus]).min(initial=np.inf))
            step = up if rng.random() < down / (up + down) else -down
            p = p + step * move
            p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
            if np.all((p > 0) & (p < 1)):
                return pi
            pi[at] = p
    return pi


def flight(pi: list[float], sizes: list[float], rng: random.Random, eps: float = 1e-9) -> list[float]:
    """Move ``pi`` through the null space of (count, sizes) until at most two entries are neither 0 nor 1."""
    pi = list(pi)
    todo = [k for k, p in enumerate(pi) if eps < p < 1 - eps]
    pi = [p if eps < p < 1 - eps else float(round(p)) for p in pi]
    held, nxt = [], 0
    while True:
        while len(held) < 3 and nxt < len(todo):
            held.append(todo[nxt])
            nxt += 1
        if len(held) < 2:
            return pi
        if len(held) == 2:
            if sizes[held[0]] != sizes[held[1]]:
                return pi
            move = [1.0, -1.0]
        else:
            a, b, c = (sizes[k] for k in held)
            move = [c - b, a - c, b - a]
            if not any(move):
                move = [1.0, -1.0, 0.0]
        up = down = math.inf
        for k, u in zip(held, move, strict=True):
            if u > 0:
                up, down = min(up, (1 - pi[k]) / u), min(down, pi[k] / u)
            elif u < 0:
                up, down = min(up, pi[k] / -u), min(down, (1 - pi[k]) / -u)
        step = up if rng.random() < down / (up + down) else -down
        left = []
        for k, u in zip(held, move, strict=True):
            p = pi[k] + step * u
            if p <= eps or p >= 1 - eps:
                pi[k] = 0.0 if p < 0.5 else 1.0
            else:
                pi[k] = p
                left.append(k)
        if len(left) == len(held):  # rounding kept all inside: settle the nearest
            k = min(left, key=lambda i: min(pi[i], 1 - pi[i]))
            pi[k] = float(round(pi[k]))
            left.remove(k)
        held = left


def landing(pi: list[float], sizes: list[float]) -> list[float]:
    """The 0/1 choice for the few undecided entries that keeps the size sum, then the count, nearest."""
    goal, count = sum(p * s for p, s in zip(pi, sizes, strict=True)), sum(pi)
    return list(map(float, min(itertools.product((0, 1), repeat=len(pi)), key=lambda c: (abs(sum(x * s for x, s in zip(c, sizes, strict=True)) - goal), abs(sum(c) - count)))))


def _fly(seed: int):
    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rng = random.Random(zlib.crc32(repr((seed, *map(str, key))).encode()))
        rows = rows.sort_values(["doc_id", "tokens"], kind="stable").sample(frac=1, random_state=rng.randrange(2**31)).reset_index(drop=True)
        sizes = rows["tokens"].to_numpy(float)
        pi = settle_heads(rows["pi"].to_numpy(float), sizes, min(64, len(rows) // 3), rng)
        order = np.argsort(-sizes, kind="stable")
        pi[order] = flight(pi[order].tolist(), sizes[order].tolist(), rng)
        rows["pi"] = pi
        return rows[["doc_id", "source", "tokens", "pi"]]

    return fly


def balanced_draw(rows: DataFrame, *, seed: int = 17, block_rows: int = 20_000, most_rounds: int = 12) -> DataFrame:
    """(doc_id, source, tokens, pi): the rows with each ``pi`` moved to 0 or 1, balanced within its source.

    A source is dealt by hash over blocks of about ``block_rows`` rows, however many it has. Each round leaves two rows of a block
    undecided; rows still undecided after ``most_rounds`` (blocks of a few rows only) are an error, never left out.
    """
    spark, done, open_rows = rows.sparkSession, None, rows
    for turn in range(most_rounds + 1):
        sizes = {r.source: r.n for r in open_rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
        if not sizes:
            return rows.limit(0) if done is None else done
        small = all(n <= 2 for n in sizes.values())
        if small:
            left = open_rows.orderBy("source", "doc_id", "tokens").collect()
            landed = []
            for _, group in itertools.groupby(left, key=lambda r: r.source):
                group = list(group)
                landed += [(r.doc_id, r.source, r.tokens, c) for r, c in zip(group, landing([r.pi for r in group], [float(r.tokens) for r in group]), strict=True)]
            last = spark.createDataFrame(landed, _ROUND)
            return last if done is None else done.unionByName(last)
        if turn == most_rounds:
            break
        parts = spark.createDataFrame([(s, max(1, math.ceil(n / block_rows))) for s, n in sizes.items()], "source string, parts long")
        block = F.pmod(F.xxhash64(F.lit(seed + turn), "doc_id", "tokens"), "parts")
        dealt = open_rows.join(F.broadcast(parts), "source").withColumn("block", block).drop("parts")  # a row for each of at most ``most_sources``
        flown = settle(dealt.groupBy("source", "block").applyInPandas(_fly(seed + turn), _ROUND), f"flight-{turn}")
        decided = flown.where("pi = 0 or pi = 1")
        done = decided if done is None else done.unionByName(decided)
        open_rows = flown.where("pi > 0 and pi < 1")
    raise RuntimeError(f"{sum(sizes.values())} rows are undecided after {most_rounds} rounds: use larger blocks than {block_rows} rows")


def mix_plan(counts: DataFrame, targets: DataFrame, most_sources: int = 10_000) -> list[dict]:
    """For each target source: its documents and tokens, the tokens it must give and how often that is its own."""
    goals = targets.where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("most")).limit(most_sources + 1).collect()
    if len(goals) > most_sources:
        raise ValueError(f"more than {most_sources} target sources")
    there = {r.source: r for r in counts.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    plan = [{"source": g.source, "share": g.share, "most": g.most, "documents": there[g.source].n if g.source in there else 0, "tokens": there[g.source].tokens if g.source in there else 0} for g in goals]
    given = [p for p in plan if p["tokens"] and p["most"] > 0]
    size = min((p["most"] * p["tokens"] / p["share"] for p in given), default=0.0)
    for p in plan:
        p["wanted"] = p["share"] * size if p in given else 0.0
        p["rate"] = min(float(p["most"]), p["wanted"] / p["tokens"]) if p["tokens"] else 0.0
    return plan


def mix_sources(documents: DataFrame, targets: DataFrame, *, ranks: str | None = None, seed: int = 17, block_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """The mix (doc_id, source, tokens, repeats) and its shares (a row for each target source).

    ``documents``: doc_id, source, text; ``targets``: source, target_share, max_repeats. Documents without id, source, text or
    token take no part, nor do sources without target. A source without tokens gives nothing; the others keep their ratio.
    Repeated rows are documents of their own. Every document of the mix is used at most its source's ``max_repeats`` times (null:
    once); several targets of one source add up. Token and document totals of a source are met but for at most two documents.
    Other columns are ignored.
    """
    spark = documents.sparkSession
    wanted = targets.select(F.col("source").alias("source")).where("source is not null").distinct()
    counts = settle(count_tokens(documents.join(wanted, "source", "left_semi"), ranks).where("tokens > 0"), "token-counts")
    plan = mix_plan(counts, targets)
    used = [p for p in plan if p["rate"] > 0]
    out = counts.limit(0).withColumn("repeats", F.lit(0))
    if used:
        rates = F.broadcast(spark.createDataFrame([(p["source"], p["rate"]) for p in used], "source string, rate double"))  # at most ``most_sources`` rows
        base = counts.join(rates, "source").withColumn("base", F.floor("rate").cast("int")).withColumn("pi", F.col("rate") - F.floor("rate"))
        drawn = balanced_draw(base.where("pi > 0").select("doc_id", "source", "tokens", "pi"), seed=seed, block_rows=block_rows)
        whole = base.where("pi = 0").select("doc_id", "source", "tokens", F.col("base").alias("repeats"))
        out = whole.unionByName(drawn.join(rates, "source").select("doc_id", "source", "tokens", (F.floor("rate").cast("int") + F.col("pi").cast("int")).alias("repeats"))).where("repeats > 0")
    got = out.groupBy("source").agg(F.count("*").alias("documents_used"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("repeats_used"))
    goals = spark.createDataFrame([(p["source"], p["share"], p["most"], p["documents"], p["tokens"]) for p in plan], "source string, target_share double, max_repeats int, documents long, tokens long")
    total = F.sum(F.coalesce("tokens_used", F.lit(0))).over(_all())
    shares = goals.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", "documents", "tokens", F.coalesce("documents_used", F.lit(0)).alias("documents_used"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"),
        F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"), F.try_divide(F.coalesce("tokens_used", F.lit(0)).cast("double"), total.cast("double")).alias("share_reached"),
    )
    return out, shares


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))  # the targets: a bounded table
