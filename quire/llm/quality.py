"""Quality rules without Python on the executors: text statistics and a learned decision list."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import SPACE_CLASS, own_columns, own_rows, words_of

#: Labelled rows that a list is learned from, at most.
SAMPLE = 8_000


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as a struct ``q_own``, with counts of their whole texts in columns that start with ``q_``.

    ``q_repeat_words``: words inside a 3-word window that is found twice or more.  A window is a hash above its
    place in one long; sorted, equal windows are neighbours, and the words themselves confirm them.
    """
    text = F.coalesce(F.col("q_text"), F.lit(""))
    out = own_rows(docs, q_text=F.col(text_col)).withColumn("q_words", words_of(F.col("q_text"))).withColumn("q_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]")))
    out = out.withColumn("q_n_words", F.size("q_words").cast("long")).withColumn("q_bits", F.length(F.bin("q_n_words")))
    out = out.withColumn(
        "q_windows",
        F.expr(
            "case when q_n_words >= 4 then sort_array(transform(sequence(0, cast(q_n_words as int) - 3), "
            "i -> shiftleft(xxhash64(q_words[i], q_words[i + 1], q_words[i + 2]), q_bits) | cast(i as bigint))) else cast(array() as array<bigint>) end"
        ),
    ).withColumn("q_mask", F.expr("cast(shiftleft(1L, q_bits) - 1 as bigint)"))
    same = (
        "shiftright(x, q_bits) = shiftright(q_windows[{0}], q_bits) and q_words[cast(x & q_mask as int)] = q_words[cast(q_windows[{0}] & q_mask as int)] "
        "and q_words[cast(x & q_mask as int) + 1] = q_words[cast(q_windows[{0}] & q_mask as int) + 1] and q_words[cast(x & q_mask as int) + 2] = q_words[cast(q_windows[{0}] & q_mask as int) + 2]"
    )
    out = out.withColumn("q_found", F.expr(f"sort_array(transform(filter(q_windows, (x, j) -> (j > 0 and {same.format('j - 1')}) or (j + 1 < size(q_windows) and {same.format('j + 1')})), x -> x & q_mask))"))
    return (
        out.withColumn("q_repeat_words", F.expr("aggregate(transform(q_found, (p, j) -> case when j + 1 < size(q_found) then least(3L, q_found[j + 1] - p) else 3L end), 0L, (a, b) -> a + b)"))
        .withColumn("q_word_chars", F.char_length(F.array_join("q_words", "")).cast("long"))
        .withColumn("q_symbols", (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"))
        .withColumn("q_upper", (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[A-Z!]", ""))).cast("long"))
        .withColumn("q_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"))
        .withColumn("q_n_lines", F.size("q_lines").cast("long"))
        .drop("q_text", "q_words", "q_lines", "q_bits", "q_windows", "q_mask", "q_found")
    )


def ratios() -> dict[str, Column]:
    """What conditions may look at: shares of a text, so that length alone decides little."""
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return {
        "symbols": part("q_symbols", "q_word_chars"),
        "upper": part("q_upper", "q_word_chars"),
        "repeats": part("q_repeat_words", "q_n_words"),
        "dup_lines": part("q_dup_lines", "q_n_lines"),
        "word_length": part("q_word_chars", "q_n_words"),
        "line_words": part("q_n_words", "q_n_lines"),
    }


@dataclass
class DecisionList:
    """Ordered rules; each is a conjunction of (statistic, '>' or '<=', threshold) that rejects."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def rejects(self) -> Column:
        """A boolean expression: the first rule that holds rejects, else the row stays."""
        found, columns = None, ratios()
        for rule in self.rules:
            holds = F.lit(True)
            for name, side, edge in rule:
                holds = holds & ((columns[name] > edge) if side == ">" else (columns[name] <= edge))
            found = F.when(holds, F.lit(True)) if found is None else found.when(holds, F.lit(True))
        return F.lit(False) if found is None else found.otherwise(F.lit(False))


def _holds(x: np.ndarray, names: list[str], rule: list[tuple[str, str, float]]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, side, edge in rule:
        column = x[:, names.index(name)]
        out &= (column > edge) if side == ">" else (column <= edge)
    return out


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.9, least: int = 3, max_rules: int = 12) -> DecisionList:
    """Sequential covering.  Two of three rows grow a rule by information gain, the third prunes it from its end.

    A rule counts if, over all rows that earlier rules leave, at least ``precision`` of those it covers are bad
    and there are ``least`` of them.  Without both classes the list is empty and rejects nothing.
    """
    rules: list[list[tuple[str, str, float]]] = []
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    edges = {n: np.unique(np.quantile(x[:, i], np.linspace(0.01, 0.99, 99))) for i, n in enumerate(names)} if len(x) else {}
    while len(rules) < max_rules and (bad & left).sum() >= least:
        grow = left & ~third
        if not (bad & grow).any():
            grow = left
        rule: list[tuple[str, str, float]] = []
        inside = grow.copy()
        while (inside & ~bad).any() and len(rule) < 4:
            p, n = (inside & bad).sum(), (inside & ~bad).sum()
            best, gain = None, 1e-9
            for i, name in enumerate(names):
                column = x[:, i]
                for edge in edges[name]:
                    for side, mask in ((">", column > edge), ("<=", column <= edge)):
                        p1 = (inside & bad & mask).sum()
                        if p1 < least:
                            continue
                        n1 = (inside & ~bad & mask).sum()
                        g = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if g > gain:
                            best, gain = (name, side, float(edge)), g
            if best is None:
                break
            rule.append(best)
            inside &= _holds(x, names, [best])
        prune = left & third

        def worth(r: list) -> float:
            covered = prune & _holds(x, names, r)
            p, n = (covered & bad).sum(), (covered & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        covered = left & _holds(x, names, rule) if rule else np.zeros(len(x), bool)
        if (covered & bad).sum() < least or (covered & bad).sum() < precision * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return DecisionList(rules)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """Learn from at most ``sample`` labelled documents, the first by a hash of their id: a bounded number of short rows.

    Rows without an id or label are left out; a document with several labels counts as the worst of them.
    """
    worst = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("q_label"))
    chosen = worst.orderBy(F.xxhash64(F.lit(3), F.col(id_col)), id_col).limit(sample)
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id")  # at most ``sample`` rows are broadcast
    rows, names = with_statistics(drawn), list(ratios())
    got = rows.select(F.xxhash64(F.lit(4), F.col("q_own.id")).alias("h"), F.col("q_own.q_label").alias("q_label"), *[c.alias(n) for n, c in ratios().items()]).orderBy("h", *names).limit(sample).collect()
    x = np.array([[r[n] for n in names] for r in got], float).reshape(len(got), len(names))
    return learn(x, np.array([r["q_label"] == 0 for r in got], bool), names)


def judged(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as a struct ``q_own`` with their statistics, ``q_base_failed`` and ``q_kept``.

    Null and blank texts have zero words and fail.  Equal rows get equal verdicts; an empty table stays empty; no
    column of ``docs`` can clash with ours.
    """
    out = with_statistics(docs, text_col)
    out = out.withColumn("q_base_failed", (F.col("q_n_words") < 50) | (F.col("q_repeat_words") * 100 > F.col("q_n_words") * 50))
    return out.withColumn("q_kept", ~F.col("q_base_failed") & ~rules.rejects())


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that neither the base limits nor the learned list reject, with all their columns; see ``judged``."""
    out = judged(docs, fit(docs, labels, id_col, text_col), text_col)
    # the row number is a barrier: pushed below the statistics, the filter would repeat them inside each other
    return own_columns(out.withColumn("q_row", F.monotonically_increasing_id()).where(F.col("q_kept") & (F.col("q_row") >= 0)), docs.columns)


def digest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its counts, whether it fails the base limits, and the verdict; see ``judged``."""
    out = judged(docs.select(id_col, text_col), fit(docs, labels, id_col, text_col), text_col)
    names = {"q_n_words": "n_words", "q_word_chars": "word_chars", "q_symbols": "n_symbols", "q_dup_lines": "n_dup_lines", "q_repeat_words": "n_repeat_words", "q_base_failed": "base_failed", "q_kept": "kept"}
    return out.select(F.col("q_own").getField(id_col).alias(id_col), *[F.col(a).alias(b) for a, b in names.items()])
