"""Consensus strings of clusters and the network between them."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.substitution import substitution_matrix
from .align import identities, path
from .graph import louvain_clusters
from .matrix import upper_quantile
from .minhash import minhash

# Residue pairs with a code of their own.
_CODES = {frozenset("DN"): "B", frozenset("EQ"): "Z", frozenset("IL"): "J"}
#: Members of one cluster that are aligned together.
MAX_MEMBERS = 20_000


#: Different members whose pairs one task aligns; larger clusters are dealt out by pairs of blocks.
CENTRE_BLOCK = 200


def multiple_alignment(seqs: list[str], matrix: np.ndarray, gap_open: int = 10, gap_ext: int = 4, centre: str | None = None) -> list[str]:
    """Star alignment around the member with the greatest mean identity to all others, or a given one; gaps once made stay."""
    distinct = list(dict.fromkeys(seqs))
    if len(distinct) == 1:
        return list(seqs)
    if centre is None:
        mean = [identities([a] * (len(distinct) - 1), [b for b in distinct if b != a], matrix, gap_open, gap_ext).mean() for a in distinct]
        centre = distinct[int(np.argmax(mean))]
    paths = {s: path(centre, s, matrix, gap_open, gap_ext) for s in distinct}
    room = [0] * (len(centre) + 1)  # insertions before each of the centre's residues
    for p in paths.values():
        at = run = 0
        for step in p + "D":
            if step == "L":
                run += 1
            else:
                room[at] = max(room[at], run)
                at, run = min(at + 1, len(centre)), 0
    out = {}
    for s, p in paths.items():
        row, at, k, run = [], 0, 0, ""
        for step in p:
            if step == "L":
                run += s[k]
                k += 1
                continue
            row += [run.rjust(room[at], "-"), s[k] if step == "D" else "-"]
            k += step == "D"
            at, run = at + 1, ""
        row.append(run.rjust(room[at], "-"))
        out[s] = "".join(row)
    return [out[s] for s in seqs]


def consensus_string(rows: list[str], threshold: float = 0.05, ambiguity: bool = True, no_consensus: str = "X") -> str:
    """By column: the residues that all but ``threshold`` of the rows have.

    One residue stands for itself; two that share a code for that; more for X. Without ``ambiguity`` the
    most frequent residue (the least letter of several) stands. Columns that are mostly gaps become ``-``.
    """
    out = []
    for column in zip(*rows, strict=True):
        count = Counter(column)
        gaps = count.pop("-", 0)
        if gaps * 2 > len(rows):
            out.append("-")
            continue
        ranked = sorted(count.items(), key=lambda x: (-x[1], x[0]))
        if not ambiguity:
            out.append(ranked[0][0])
            continue
        need, have, kept = (1 - threshold) * (len(rows) - gaps), 0, []
        for letter, n in ranked:
            if have >= need:
                break
            kept.append(letter)
            have += n
        out.append(kept[0] if len(kept) == 1 else _CODES.get(frozenset(kept), no_consensus))
    return "".join(out)


def centres(clustered: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(c_index, centre) of clusters with more than 200 different members: the greatest mean identity to all others, the least seq_id of several."""
    members = clustered.groupBy("c_index", "pep").agg(F.min("seq_id").alias("seq_id"))
    sizes = members.groupBy("c_index").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CENTRE_BLOCK)
    dealt = members.join(sizes, "c_index").withColumn("blocks", F.ceil(F.col("n") / CENTRE_BLOCK)).withColumn("block", F.pmod(F.xxhash64("pep"), F.col("blocks")))
    lists = dealt.groupBy("c_index", "n", "blocks", "block").agg(F.collect_list(F.struct("seq_id", "pep")).alias("members"))
    left = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = lists.select("c_index", F.col("block").alias("other"), F.col("members.pep").alias("others"))
    pairs = left.join(right, ["c_index", "other"]).select("c_index", "n", "members.seq_id", "members.pep", "others")

    def run(frames):
        for f in frames:
            for t in f.itertuples(index=False):
                total = [identities([a] * len(o), o, matrix).sum() for a in t.pep for o in [[b for b in t.others if b != a]]]
                yield pd.DataFrame({"c_index": t.c_index, "n": t.n, "seq_id": t.seq_id, "pep": t.pep, "total": total})

    parts = pairs.mapInPandas(run, f"c_index string, n long, seq_id {clustered.schema['seq_id'].dataType.simpleString()}, pep string, total double")
    mean = parts.groupBy("c_index", "seq_id", "pep").agg(F.round(F.sum("total") / (F.first("n") - 1), 12).alias("mean"))
    return mean.groupBy("c_index").agg(F.min_by("pep", F.struct(-F.col("mean"), "seq_id")).alias("centre"))


def cluster_consensus(clustered: DataFrame, threshold: float = 0.05, ambiguity: bool = True, matrix_name: str = "BLOSUM62") -> DataFrame:
    """(cluster_id, consensus) of (seq_id, pep, c_index); single members pass through; an empty table gives an empty one.

    A cluster is aligned in one task; more than 20,000 members are an error.
    """
    matrix = substitution_matrix(matrix_name)
    sizes = clustered.groupBy("c_index").count().where(F.col("count") > MAX_MEMBERS)
    if not sizes.isEmpty():
        raise ValueError(f"a cluster has more than {MAX_MEMBERS} members")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        peps = f.sort_values("seq_id")["pep"].tolist()
        centre = f["centre"].iloc[0]
        rows = multiple_alignment(peps, matrix, centre=centre if isinstance(centre, str) else None)
        return pd.DataFrame({"cluster_id": f["c_index"].iloc[:1], "consensus": [consensus_string(rows, threshold, ambiguity)]})

    clustered = clustered.select("seq_id", "pep", "c_index")
    return clustered.join(centres(clustered, matrix), "c_index", "left").groupBy("c_index").applyInPandas(run, "cluster_id string, consensus string")


def column_majority(clustered: DataFrame) -> DataFrame:
    """(cluster_id, consensus): each place's most frequent letter, the least of several. Native.

    Members of a cluster must be equally long; a cluster where they aren't has a null consensus.
    """
    lengths = clustered.groupBy("c_index").agg(F.min(F.length("pep")).alias("lo"), F.max(F.length("pep")).alias("hi"))
    even, uneven = lengths.where("lo = hi").select("c_index"), lengths.where("lo <> hi")
    letters = clustered.join(even, "c_index", "left_semi").select("c_index", F.posexplode(F.split("pep", "")).alias("at", "letter")).where("letter <> ''")
    best = letters.groupBy("c_index", "at", "letter").count().groupBy("c_index", "at").agg(F.min_by("letter", F.struct(-F.col("count"), F.col("letter"))).alias("letter"))
    ordered = best.groupBy("c_index").agg(F.array_sort(F.collect_list(F.struct("at", "letter"))).alias("x"))
    out = ordered.select(F.col("c_index").alias("cluster_id"), F.array_join(F.transform("x", lambda x: x["letter"]), "").alias("consensus"))
    return out.unionByName(uneven.select(F.col("c_index").alias("cluster_id"), F.lit(None).cast("string").alias("consensus")))


def spring_layout(n: int, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, seed: int = 0, rounds: int = 200) -> np.ndarray:
    """Fruchterman-Reingold places of n nodes."""
    rng = np.random.default_rng(seed)
    at, k = rng.random((n, 2)), 1 / np.sqrt(max(n, 1))
    for t in np.linspace(0.1, 0.001, rounds):
        delta = at[:, None] - at[None]
        far = np.maximum(np.hypot(delta[..., 0], delta[..., 1]), 1e-6)
        move = (delta / far[..., None] * (k * k / far)[..., None]).sum(1)
        if len(src):
            pull = delta[src, dst] * (far[src, dst] / k * weight)[:, None]
            np.add.at(move, src, -pull)
            np.add.at(move, dst, pull)
        size = np.maximum(np.hypot(move[:, 0], move[:, 1]), 1e-9)
        at = at + move / size[:, None] * np.minimum(size, t)[:, None]
    return at


#: Nodes of a network that may be drawn.
MAX_NODES = 2000


def consensus_network(consensus: DataFrame, k_size: int = 2, hash_size: int = 50, threshold_p: float = 0.8, sens: float = 1.05, seed: int = 0, weight: str = "distance") -> tuple[DataFrame, DataFrame]:
    """nodes (id, name, cluster, x, y) and edges (src, dst, weight) between consensus strings.

    Weights are MinHash distances from their quantile up, so that edges join the least alike;
    ``weight="similarity"`` turns that round.
    """
    rows = consensus.orderBy("cluster_id").limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"a network of more than {MAX_NODES} nodes can't be drawn")
    spark = consensus.sparkSession
    nodes = spark.createDataFrame([(i + 1, r.cluster_id, r.consensus) for i, r in enumerate(rows)], "seq_id long, name string, sequence string")
    pairs = minhash(nodes, k_size, hash_size, seed).dist_matrix
    if weight == "similarity":
        pairs = pairs.withColumn("distance", 1 - F.col("distance"))
    limit = upper_quantile(pairs, threshold_p, "distance").first()[0]
    edges = pairs.where((F.col("distance") >= F.lit(limit)) & (F.col("distance") > 0)).select(F.col("i").alias("src"), F.col("j").alias("dst"), F.col("distance").alias("weight"))
    of = louvain_clusters(nodes.select(F.col("seq_id").alias("id")), edges, sens, seed)
    e = edges.toPandas()
    at = spring_layout(len(rows), e["src"].to_numpy() - 1, e["dst"].to_numpy() - 1, e["weight"].to_numpy(float), seed)
    places = spark.createDataFrame([(i + 1, float(x), float(y)) for i, (x, y) in enumerate(at)], "id long, x double, y double")
    return nodes.select(F.col("seq_id").alias("id"), "name").join(of, "id").join(places, "id"), edges
