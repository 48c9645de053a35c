"""Quality rules as a short-circuit cascade, ordered by rejections per cost as estimated on a sample."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
_LETTERLESS = re.compile(rb"(?<![^ \t-\r])[^A-Za-z\x80-\xff \t-\r]+(?![^ \t-\r])")
#: Documents of the sample that the order of the rules is estimated on; the order changes the cost only, never a verdict.
ORDER_SAMPLE = 1000


class Text:
    """One document; each measure is made when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes split at the six ASCII white-space characters

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if len(w) < 4:  # one window at most
            return 0
        first: dict[tuple[bytes, bytes, bytes], int] = {}
        repeated: set[int] = set()
        for i, window in enumerate(zip(w, w[1:], w[2:])):
            if (j := first.setdefault(window, i)) != i:
                repeated.update((i, i + 1, i + 2, j, j + 1, j + 2))
        return len(repeated)

    @cached_property
    def n_letterless(self) -> int:
        return len(_LETTERLESS.findall(self.text.encode("utf-8", "surrogatepass")))

    @cached_property
    def n_shouted(self) -> int:
        return sum(map(bytes.isupper, self.words))


Rule = Callable[[Text], bool]
#: A rule is true for a text that it rejects.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda t: t.n_words < 50,
    "repeated_words": lambda t: 100 * t.n_repeat_words > 50 * t.n_words,
}
MORE_RULES: dict[str, Rule] = {
    "symbols": lambda t: 10 * t.n_symbols > t.n_words,
    "repeated_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "letterless_words": lambda t: 5 * t.n_letterless > t.n_words,
    "shouting": lambda t: 10 * t.n_shouted > 3 * t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words,
}
BASE_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def order_rules(docs: DataFrame, rules: dict[str, Rule], sample: int = ORDER_SAMPLE) -> list[str]:
    """Names of the rules, the most rejections per second of the sample first; ties by name, and all by name for an empty sample."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                for name, rule in rules.items():
                    t = Text(text)
                    t.words  # noqa: B018  every rule needs them
                    begin = time.perf_counter()
                    rejects = rule(t)
                    rows.append((name, time.perf_counter() - begin, int(rejects)))
            yield pd.DataFrame(rows, columns=["rule", "cost", "rejected"])

    n = docs.count()
    picked = docs.select("text").sample(min(1.0, sample / max(n, 1)), seed=3)
    found = picked.mapInPandas(measure, "rule string, cost double, rejected long").groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected"))
    rate = {r["rule"]: r["rejected"] / max(r["cost"], 1e-9) for r in found.collect()}  # a row for each rule
    return sorted(rules, key=lambda name: (-rate.get(name, 0.0), name))


def cascade(order: list[str], rules: dict[str, Rule], measures: list[str]) -> Callable[[Column], Column]:
    """A column function of a text: a struct of the measures and of failed, the first rule in order that rejects it (null: none)."""

    def score(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            rows = []
            for text in texts:
                t = Text(text)
                failed = next((name for name in order if rules[name](t)), None)
                rows.append((*(getattr(t, m) for m in measures), failed))
            out = pd.DataFrame(rows, columns=[*measures, "failed"])
            yield out.astype({m: "int64" for m in measures} | {"failed": "object"})

    score.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(score, ", ".join([*(f"{m} long" for m in measures), "failed string"]))


def quality_rules(docs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for each row of docs.

    A null text has no words (and so fails for few words). All rows get the base measures; the cascade then runs over base
    rules and the further ones in the estimated order and stops at the first that rejects. Repeated rows are judged alike, an empty table gives
    no rows, and columns other than doc_id and text are not read. A text is kept if no rule rejects it, whatever the order; which rule came
    first depends on timings and so is not returned. Whole texts of any length are measured.
    """
    rules = BASE_RULES | (MORE_RULES if rules is None else rules)
    order = order_rules(docs, rules)
    q = docs.select("doc_id", cascade(order, rules, BASE_MEASURES)(F.col("text")).alias("q")).select("doc_id", "q.*")
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return q.select("doc_id", *BASE_MEASURES, base_failed.alias("base_failed"), F.col("failed").isNull().alias("kept"))


def keep_good(docs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, with their columns and without a shuffle; nothing is measured past the first rejection.

    Each row is judged alone, so null and repeated ids and repeated rows are rows like any other; null texts have too few words; an empty
    table stays empty; columns of any name stay as they are.
    """
    rules = BASE_RULES | (MORE_RULES if rules is None else rules)
    return docs.filter(cascade(order_rules(docs, rules), rules, [])(F.col("text"))["failed"].isNull())
