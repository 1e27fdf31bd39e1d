"""Answer extraction and scoring as column expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.functions.arrays import let, occurrences
from memloom.functions.text import split_words, strip, within

_PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def strip_thinking(text: Column, tag: str = "think") -> Column:
    """What stands between the first and the second closing tag, trimmed; "Empty" if an opening tag is left in it; a text without a closing tag stays."""
    parts = F.split(text, f"</{tag}>", -1)
    body = F.when(F.size(parts) > 1, strip(F.element_at(parts, 2))).otherwise(text)
    return F.when(F.contains(body, F.lit(f"<{tag}>")), F.lit("Empty")).otherwise(body)


def extract_boxed(text: Column) -> Column:
    """The first boxed group without inner braces, trimmed; else the whole text, trimmed."""
    found = F.regexp_extract(text, r"\\boxed\{([^{}]*)\}", 1)
    return F.when(text.rlike(r"\\boxed\{[^{}]*\}"), strip(found)).otherwise(strip(text))


def extract_prefixed(text: Column) -> Column:
    """The rest of the line after `Answer:` in any case, else the first line; the prefix goes if it repeats."""
    after = F.regexp_extract(text, r"(?i)answer:[ \t]*([^\n]*)", 1)
    first = F.regexp_extract(text, r"^([^\n]*)", 1)
    picked = F.when(text.rlike("(?i)answer:"), after).otherwise(first)
    return strip(F.regexp_replace(picked, r"^(?i:answer:[ \t]*)+", ""))


def extract_last_tag(text: Column, tag: str = "answer") -> Column:
    """The body of the last <tag>...</tag>, trimmed; null without one."""
    found = F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.element_at(found, -1)))


def count_tags(text: Column, tag: str = "answer") -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(f"<{tag}>"), F.lit(0))).cast("long")


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    bare = F.regexp_replace(F.lower(text), _PUNCTUATION, "")
    return strip(F.regexp_replace(F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "), r"\s+", " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    """1.0 if any gold equals the prediction, both normalised."""
    return F.exists(golds, lambda g: normalize_answer(g) == normalize_answer(prediction)).cast("double")


def substring_match(prediction: Column, golds: Column) -> Column:
    """1.0 if any normalised gold stands in the normalised prediction."""
    return F.exists(golds, lambda g: F.contains(normalize_answer(prediction), normalize_answer(g))).cast("double")


def overlap_f1(prediction: Column, gold: Column) -> Column:
    """Multiset F1 of normalised words; a yes, no or noanswer that differs scores 0."""
    words = lambda t: F.filter(F.split(t, " "), lambda w: w != "")
    plain = F.array(*[F.lit(x) for x in ("yes", "no", "noanswer")])

    def counted(t: Column) -> Column:
        p, g = words(t["a"]), words(t["b"])
        differ = (t["a"] != t["b"]) & (F.array_contains(plain, t["a"]) | F.array_contains(plain, t["b"]))
        common = F.when(differ, F.lit(0)).otherwise(F.size(F.array_intersect(occurrences(p), occurrences(g))))
        return let(F.struct(common.alias("c"), F.size(p).alias("p"), F.size(g).alias("g")), score)

    def score(n: Column) -> Column:
        precision, recall = n["c"] / n["p"], n["c"] / n["g"]
        return F.when(n["c"] == 0, F.lit(0.0)).otherwise(2 * precision * recall / (precision + recall))

    return let(F.struct(normalize_answer(prediction).alias("a"), normalize_answer(gold).alias("b")), counted)


def token_f1(prediction: Column, golds: Column) -> Column:
    """The best overlap_f1 over the golds."""
    return F.array_max(F.transform(golds, lambda g: overlap_f1(prediction, g)))


def set_f1(prediction: Column, gold: Column) -> Column:
    """Set overlap F1 of words after . , ! ? become spaces; 1 when equal but for case; 0 for null or empty."""
    words = lambda t: F.array_distinct(split_words(F.regexp_replace(F.lower(t), "[.,!?]", " ")))
    p, g = words(prediction), words(gold)
    common = F.size(F.array_intersect(p, g))
    f1 = 2.0 * common / (F.size(p) + F.size(g))
    blank = prediction.isNull() | gold.isNull() | (strip(prediction) == "") | (strip(gold) == "")
    return F.when(blank, 0.0).when(F.lower(prediction) == F.lower(gold), 1.0).when(common == 0, 0.0).otherwise(f1)


def keyword_recall(prediction: Column, keywords: Column) -> Column:
    """Share of keywords (array) that stand in the prediction, in any case."""
    return F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: within(k, prediction))) / F.size(keywords)).otherwise(0.0)


def containment(prediction: Column, gold: Column) -> Column:
    return within(gold, prediction).cast("double")


def multi_part_recall(prediction: Column, gold: Column) -> Column:
    """Share of `;` parts that stand in the prediction. Several parts: lower-cased parts against the prediction as it is; one part: both lower-cased."""
    parts = F.transform(F.split(gold, ";"), lambda p: F.lower(strip(p)))
    several = F.size(F.filter(parts, lambda p: F.contains(prediction, p))) / F.size(parts)
    return F.when(F.size(parts) > 1, several).otherwise(within(strip(gold), prediction).cast("double"))


def strict_integer_label(prediction: Column, gold: Column) -> Column:
    """1.0 if the boxed prediction, without quotes, is all digits and equals the gold."""
    label = F.regexp_replace(extract_boxed(prediction), "[\"']", "")
    return (label.rlike(r"^[0-9]+$") & (label == strip(gold))).cast("double")


def hierarchical_label(prediction: Column, gold: Column, weights: tuple[float, ...] = (0.5, 0.3, 0.2)) -> Column:
    """`a > b > c` labels: weights of the leading levels that agree; 0 if either is not of that form."""
    p, g = (F.transform(F.split(t, ">"), lambda x: F.lower(strip(x))) for t in (prediction, gold))
    score, same = F.lit(0.0), F.lit(True)
    for k, w in enumerate(weights, 1):
        same = same & (F.try_element_at(p, F.lit(k)) == F.try_element_at(g, F.lit(k)))
        score = score + F.when(same, w).otherwise(0.0)
    return F.when((F.size(p) == len(weights)) & (F.size(g) == len(weights)), score).otherwise(0.0)


def all_elements_found(prediction: Column, golds: Column) -> Column:
    return F.forall(golds, lambda g: within(g, prediction)).cast("double")


def option_match(raw: Column, parsed: Column, option: Column) -> Column:
    """1.0 if the option's text stands in the raw or the parsed answer."""
    return F.greatest(containment(raw, option), containment(parsed, option))


def number_answer(text: Column, strict: bool = True) -> Column:
    """The last `#### n`, or (not strict) the last number, without commas; null without one."""
    pattern = r"#### (-?[0-9.,]+)" if strict else r"(-?[0-9][0-9.,]*)"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.regexp_replace(F.element_at(found, -1), "[,]|[.]$", ""))


def number_answer_score(text: Column, gold: Column, strict: bool = True, format_score: float = 0.0) -> Column:
    n = number_answer(text, strict)
    return F.when(n.isNull(), 0.0).when(n == gold, 1.0).otherwise(format_score)


def tag_em_score(text: Column, golds: Column, substring: bool = False, most_tags: int = 10) -> Column:
    """Match of the last tagged answer; a quarter of it with more than `most_tags` tags; 0 without a tag."""
    answer = extract_last_tag(text)
    score = substring_match(answer, golds) if substring else exact_match(answer, golds)
    return F.when(answer.isNull(), 0.0).when(count_tags(text) > most_tags, score / 4).otherwise(score)


def parse_judge_label(text: Column) -> Column:
    """1.0 only for a verdict that says CORRECT and not WRONG."""
    return (F.contains(text, F.lit("CORRECT")) & ~F.contains(text, F.lit("WRONG"))).cast("double")


def judge_yes(text: Column) -> Column:
    """1.0 for a verdict that says yes and not no."""
    return (F.contains(F.lower(text), F.lit("yes")) & ~F.contains(F.lower(text), F.lit("no"))).cast("double")


def multi_objective_score(answer: Column, gold: Column) -> Column:
    """`;` parts of a tagged answer against those of the gold: sum over places of an equal part or else the set F1; 0 if tags are not balanced or counts differ."""
    body = extract_last_tag(answer)
    opened, closed = (F.size(F.regexp_extract_all(answer, F.lit(t), F.lit(0))) for t in ("<answer>", "</answer>"))
    flat = lambda t: F.regexp_replace(t, _PUNCTUATION, " ")
    p, g = F.split(body, ";"), F.split(gold, ";")
    parts = F.zip_with(p, g, lambda a, b: F.when(normalize_answer(a) == normalize_answer(b), 1.0).otherwise(set_f1(flat(a), flat(b))))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when((opened == closed) & body.isNotNull() & (F.size(p) == F.size(g)), total).otherwise(0.0)


def is_answer_correct(prediction: Column, gold: Column) -> Column:
    """Both not blank, and the trimmed gold stands in the prediction in any case; false for null."""
    return F.coalesce((strip(prediction) != "") & (strip(gold) != "") & within(strip(gold), strip(prediction)), F.lit(False))
