"""What single features add to a row's score.

For a linear model, coefficient times distance from the mean. For boosted trees, along the path a row
takes through each tree, the difference between the means of a node and its child, which goes to the
feature the node asks; what a row's features add up to is its margin less that of the trees' roots.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prioscope.functions import text as T
from prioscope.operators.features import humanised_name

UP, DOWN = "↑ Towards Mismatch", "↓ Away from Mismatch"


def linear_contributions(df: DataFrame, coefficients: DataFrame, key: str = "ticket_id",
                         value: str = "value") -> DataFrame:
    """(key, idx, contribution) of a long feature table.

    ``coefficients`` has one row per feature (idx, coef, mean), as many as the model
    has features, and is broadcast.
    """
    return df.join(F.broadcast(coefficients), "idx").selectExpr(
        key, "idx", f"coef * ({value} - mean) AS contribution"
    )


def describe(name: str, contribution: str) -> str:
    """The attribution record of one feature."""
    return (
        f"named_struct('feature', {name}, 'human_name', {humanised_name(name)}, "
        f"'shap_value', round({contribution}, 4), "
        f"'direction', IF({contribution} > 0, '{UP}', '{DOWN}'))"
    )


@dataclass(frozen=True)
class PathModel:
    """The nodes of boosted models, a tree after the other; of several models, the mean of their margins.

    A row goes left where its ``feature`` is at most ``threshold``; leaves have feature -1. ``value`` is the
    node's mean times the share its tree has of the margin. Its size is that of the models, not of any table.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    @classmethod
    def of(cls, models: Sequence[GBTClassificationModel]) -> PathModel:
        nodes: list[list] = []
        roots: list[int] = []
        depth = 0
        for model in models:
            for tree, weight in zip(model.trees, model.treeWeights, strict=True):
                share = weight / len(models)
                depth = max(depth, tree.depth)
                roots.append(len(nodes))
                nodes.append([-1, 0.0, 0, 0, 0.0])
                todo = [(tree._call_java("rootNode"), roots[-1])]
                while todo:
                    node, at = todo.pop()
                    nodes[at][4] = node.prediction() * share
                    if node.subtreeDepth():
                        split = node.split()
                        nodes[at][:4] = split.featureIndex(), split.threshold(), len(nodes), len(nodes) + 1
                        todo += [(node.leftChild(), len(nodes)), (node.rightChild(), len(nodes) + 1)]
                        nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
        feature, threshold, left, right, value = map(np.array, zip(*nodes, strict=True)) if nodes else [np.zeros(0)] * 5
        return cls(feature.astype(int), threshold, left.astype(int), right.astype(int), value, np.array(roots, int), depth)

    @property
    def base(self) -> float:
        """The margin of a row before any feature is known."""
        return float(self.value[self.roots].sum())

    def contributions(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """What each of ``columns`` (features that the trees ask, ascending) adds to the margin of each row of their values."""
        out = np.zeros(rows.shape)
        every = np.arange(len(rows))
        own = np.searchsorted(columns, self.feature)
        for root in self.roots:
            at = np.full(len(rows), root)
            for _ in range(self.depth):
                inner = every[self.feature[at] >= 0]
                if not len(inner):
                    break
                node = at[inner]
                goes_left = rows[inner, own[node]] <= self.threshold[node]
                child = np.where(goes_left, self.left[node], self.right[node])
                out[inner, own[node]] += self.value[child] - self.value[node]
                at[inner] = child
        return out


def with_path_contributions(df: DataFrame, model: PathModel, top_n: int | None = None,
                            vector: str = "features", name: str = "contributions") -> DataFrame:
    """Add the features that move a row's margin, the most first (of equals the lower index): array of (idx, c).

    All of them, or the first ``top_n``. Row by row: nothing is shuffled.
    """
    columns = np.unique(model.feature[model.feature >= 0])

    @F.pandas_udf("array<struct<idx: int, c: double>>")
    def of(vectors: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in vectors:
            out: list[list] = []
            for k in range(0, len(batch), 1024):
                part = batch.iloc[k : k + 1024]
                sizes = [len(i) for i in part["indices"]]
                row = np.repeat(np.arange(len(part)), sizes)
                idx = np.fromiter(chain.from_iterable(part["indices"]), int, sum(sizes))
                x = np.fromiter(chain.from_iterable(part["values"]), float, sum(sizes))
                at = np.searchsorted(columns, idx)
                asked = at < len(columns)
                asked[asked] = columns[at[asked]] == idx[asked]
                values = np.zeros((len(part), len(columns)))
                values[row[asked], at[asked]] = x[asked]
                c = model.contributions(values, columns)
                order = np.argsort(-np.round(np.abs(c), 12), axis=1, kind="stable")[:, :top_n]
                out += [[(int(columns[j]), float(own[j])) for j in first if own[j]] for own, first in zip(c, order, strict=True)]
            yield pd.Series(out)

    parts = F.unwrap_udt(vector)
    indices = F.when(parts["type"] == 0, parts["indices"]).otherwise(F.sequence(F.lit(0), F.size(parts["values"]) - 1))
    return df.withColumn(name, of(F.struct(indices.alias("indices"), parts["values"].alias("values"))))


def with_path_attributions(df: DataFrame, names: Sequence[str], model: PathModel, top_n: int = 5) -> DataFrame:
    """Add ``shap_attributions``: the top features of each row by its paths, without a shuffle; fewer if fewer count."""
    added = with_path_contributions(df, model, top_n, name="_contributions")
    body = f"transform(_contributions, x -> {describe('get(names, x.idx)', 'x.c')})"
    return T.derive(added, {"shap_attributions": T.let("names", T.sql_strings(names), body)}).drop("_contributions")


def with_attributions(df: DataFrame, names: Sequence[str], coefficients: Sequence[float],
                      means: Sequence[float], top_n: int = 5,
                      entries: str = "entries") -> DataFrame:
    """Add ``shap_attributions``: the exact top features of each row, without a shuffle.

    Features the row does not have contribute -coef * mean. Sorted once for all rows,
    the first ``top_n`` of them that the row lacks are among the first ``top_n`` + (number
    of present features), and are found in time linear in that number.
    """
    base = sorted(
        range(len(coefficients)), key=lambda i: (-abs(coefficients[i] * means[i]), i)
    )
    absent = (
        f"transform(slice(array_except(slice(bi, 1, {top_n} + size(present)), present), 1, {top_n}), "
        "i -> named_struct('idx', i, 'c', -get(coef, i) * get(mean, i)))"
    )
    own = (
        f"transform({entries}, e -> named_struct('idx', e.idx, "
        "'c', get(coef, e.idx) * (e.weight - get(mean, e.idx))))"
    )
    ordered = (
        f"transform(concat({own}, {absent}), "
        "b -> named_struct('o', -round(abs(b.c), 12), 'idx', b.idx, 'c', b.c))"
    )
    record = describe("get(names, x.idx)", "x.c")
    body = f"transform(slice(array_sort({ordered}), 1, {top_n}), x -> {record})"
    body = T.let("present", f"{entries}.idx", body)
    for name, constant in (
        ("names", T.sql_strings(names)),
        ("bi", f"CAST(split('{','.join(map(str, base))}', ',') AS ARRAY<INT>)"),
        ("mean", T.doubles(means)),
        ("coef", T.doubles(coefficients)),
    ):
        body = T.let(name, constant, body)
    return T.derive(df, {"shap_attributions": body})
