"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of whole texts are computed by column expressions, without exploding words. Rules are learned by sequential
covering from labelled documents: a rule is a conjunction of thresholds on statistics that selects documents of bad
quality. It is grown on two thirds of the sample, condition by condition, by FOIL gain; then pruned on the other third, dropping
final conditions as long as (bad - good) / (bad + good) of what it covers there does not fall. It is kept if, on that third, its precision
(with one good document added as a prior) reaches `precision`; the documents it covers are removed and the next rule is grown. The ordered rules
become one CASE expression.

Learning is driver work on a bounded sample: at most `sample_rows` labelled documents, chosen by a hash of
their id. Statistics, thresholds' application and verdicts cover all documents.

Null text has no words (n_words 0, base_failed). Rows with a null id are judged but not learned from. Without labels, or with one quality only, no
rule is learned and kept = not base_failed. Of contradicting labels of an id the lowest counts; of conditions with equal gains the first by feature and threshold. Repeated rows are judged
each. Very long texts are judged whole, in memory of some 60 bytes a word. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, release, written

#: Statistics that rules may use: name -> expression over the base columns.
FEATURES = {
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "bang_ratio": "n_bangs / greatest(n_words, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable isn't computed again at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words in windows of three that occur twice or more, the first occurrence included.

    Each window becomes one long, its hash above its place; after sorting, windows with equal hashes are neighbours. Places take as many bits as the text's length
    needs, the hash all others. Equal hashes only propose (and a text without any, the usual case, is done): in the order of (hash, words) a window is
    repeated if a neighbour has the same three words. The places of these, sorted again, cover min(3, distance to the next) words each.
    """

    def covered(bits: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long")),
        )
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def proposed(ordered: Column) -> Column:
            def twin(x: Column, i: Column) -> Column:
                same = F.call_function("shiftrightunsigned", x, bits)
                return (same == F.call_function("shiftrightunsigned", F.get(ordered, i - 1), bits)) | (same == F.call_function("shiftrightunsigned", F.get(ordered, i + 1), bits))

            return F.transform(F.filter(ordered, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x.bitwiseAND(mask).cast("int"))

        def places(found: Column) -> Column:
            def with_words(x: Column) -> Column:
                return F.struct(F.get(words, x).alias("a"), F.get(words, x + 1).alias("b"), F.get(words, x + 2).alias("c"), x.alias("at"))

            def verified(ordered: Column) -> Column:
                def same(x: Column, y: Column) -> Column:
                    return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

                real = F.filter(ordered, lambda x, i: F.coalesce(same(x, F.get(ordered, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(ordered, i + 1)), F.lit(False)))
                return F.sort_array(F.transform(real, lambda x: x["at"]))

            return _bind(F.sort_array(F.transform(found, with_words)), verified)

        def total(at: Column) -> Column:
            own = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), x + 3) - x))
            return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

        return _bind(_bind(F.sort_array(windows), proposed), lambda found: F.when(F.size(found) == 0, F.lit(0).cast("long")).otherwise(_bind(places(found), total)))

    bits = F.ceil(F.log2(F.size(words).cast("double") + 1)).cast("int")
    return F.when(F.size(words) < 6, _few(words)).otherwise(_bind(bits, covered))


def _few(words: Column) -> Column:
    """As _repeated(), for fewer than six words: two windows can then only be equal if they overlap, all words being one or alternating."""
    def same(i: int, j: int) -> Column:
        return (F.get(words, F.lit(i)) == F.get(words, F.lit(j))) & (F.get(words, F.lit(i + 1)) == F.get(words, F.lit(j + 1))) & (F.get(words, F.lit(i + 2)) == F.get(words, F.lit(j + 2)))

    def part(i: int) -> Column:
        """Whether the window at i has a twin."""
        found = F.lit(False)
        for j in range(3):
            if j != i:
                found = found | F.coalesce(same(min(i, j), max(i, j)), F.lit(False))
        return found

    total = F.lit(0).cast("long")
    for word in range(5):
        inside = F.lit(False)
        for i in range(max(0, word - 2), min(2, word) + 1):
            inside = inside | part(i)
        total = total + F.when(inside, 1).otherwise(0)
    return total


def _n_of(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", "")).cast("long")


def with_statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.regexp_replace(text, f"^[{SPACE}]+", "")
    words = F.split(trimmed, f"[{SPACE}]+")

    def of_words(own: Column) -> Column:
        # split() leaves an empty last element where the text ends with white space, or is empty
        own_words = F.when(F.element_at(own, -1) == "", F.slice(own, 1, F.size(own) - 1)).otherwise(own)
        return _bind(own_words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).alias("n_repeat_words")))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    of_lines = _bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return documents.select(
        "doc_id", _bind(words, of_words).alias("_w"), of_lines.alias("_l"),
        _n_of(text, "#*$%&|<>").alias("n_symbols"), _n_of(text, "A-Z").alias("n_upper"), _n_of(text, "!").alias("n_bangs"),
    ).select("doc_id", "_w.*", "_l.*", "n_symbols", "n_upper", "n_bangs")


Condition = tuple[str, str, float]


def _holds(row: dict, rule: list[Condition]) -> bool:
    return all(row[f] >= t if op == ">=" else row[f] <= t for f, op, t in rule)


def _best_condition(rows: list[tuple[dict, bool]], steps: int) -> Condition | None:
    """The condition with the largest FOIL gain: bad rows kept * (log2 precision after - before). Thresholds are the
    features' quantiles among the bad rows."""
    bad = sum(y for _, y in rows)
    before, best, found = math.log2(bad / len(rows)), 1e-9, None
    for f in FEATURES:
        ordered = sorted(((r[f], y) for r, y in rows), key=lambda x: x[0])
        own = [v for v, y in ordered if y]
        for t in sorted({own[min(len(own) - 1, len(own) * i // steps)] for i in range(steps + 1)}):
            for op in (">=", "<="):
                kept = [y for v, y in ordered if (v >= t if op == ">=" else v <= t)]
                p = sum(kept)
                if p and (gain := p * (math.log2(p / len(kept)) - before)) > best:
                    best, found = gain, (f, op, t)
    return found


def learn_rules(rows: list[tuple[dict, bool]], precision: float = 0.85, most_rules: int = 16, most_conditions: int = 4, steps: int = 24) -> list[list[Condition]]:
    """rows: (features, bad). Every third row is for pruning and for the decision to keep a rule."""
    grow, prune, rules = [x for i, x in enumerate(rows) if i % 3], rows[::3], []
    while len(rules) < most_rules and any(y for _, y in grow):
        rule: list[Condition] = []
        inside = grow
        while len(rule) < most_conditions and not all(y for _, y in inside) and (c := _best_condition(inside, steps)):
            rule.append(c)
            inside = [x for x in inside if _holds(x[0], [c])]

        def worth(r: list[Condition]) -> float:
            own = [y for x, y in prune if _holds(x, r)]
            return (2 * sum(own) - len(own)) / len(own) if own else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = [y for x, y in prune if _holds(x, rule)] if rule else []
        if not rule or sum(covered) / (len(covered) + 1) < precision:
            break
        rules.append(rule)
        grow = [x for x in grow if not _holds(x[0], rule)]
        prune = [x for x in prune if not _holds(x[0], rule)]
    return rules


def list_expression(rules: list[list[Condition]]) -> Column:
    """The number (from 1) of the first rule that holds, 0 if none does."""
    if not rules:
        return F.lit(0)
    chosen = F
    for i, rule in enumerate(rules):
        test = F.lit(True)
        for f, op, t in rule:
            value = F.expr(FEATURES[f])
            test = test & (value >= F.lit(t) if op == ">=" else value <= F.lit(t))
        chosen = chosen.when(test, i + 1)
    return chosen.otherwise(0)


def quality_rules(documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000, precision: float = 0.85) -> tuple[DataFrame, list[list[Condition]]]:
    """Statistics and verdict of each row of documents, and the rules."""
    stats = written(with_statistics(documents))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality"))
    features = [F.expr(x).cast("double").alias(f) for f, x in FEATURES.items()]
    labelled = stats.filter(~base).join(judged, F.col("doc_id") == F.col("_id")).select("_id", "_quality", *features)
    labelled = written(labelled)
    # About sample_rows rows by a hash of the id: no task or driver gets more than its share of them.
    share = min(1.0, 0.97 * sample_rows / max(1, labelled.count()))
    sample = labelled.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) <= int(share * (1 << 20))).limit(sample_rows).collect()
    release(labelled)
    sample.sort(key=lambda r: zlib.crc32(str(r["_id"]).encode()))
    rules = learn_rules([({f: r[f] for f in FEATURES}, r["_quality"] == 0) for r in sample], precision)
    verdict = stats.withColumn("base_failed", base).withColumn("rule", list_expression(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"), rules
