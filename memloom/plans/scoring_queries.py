"""Answer scoring on conversations: an assistant turn against golds made from it and from the turn before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import answers as A
from memloom.functions.text import split_words
from memloom.operators import scoring
from memloom.plans.registry import query, table

#: Pairs of turns: pred is an assistant text; golds are words of it or of the user text before it.
PAIRS = r"""
SELECT a.conv_id, a.turn, a.text AS pred, u.text AS ask,
  string_split_regex(trim(u.text), '[ \t\n\r\f\v]+') AS aw, string_split_regex(trim(a.text), '[ \t\n\r\f\v]+') AS pw
FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn = a.turn - 1
WHERE a.role = 'assistant' AND u.role = 'user'
"""
_NORM = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda nw: nw NOT IN ('', 'a', 'an', 'the')), ' ')"


def norm(x: str) -> str:
    return _NORM.format(x)


def pairs(spark, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    a = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("pred"))
    u = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("ask"))
    both = a.join(u, ["conv_id", "turn"])
    return both.withColumns({"aw": split_words(F.col("ask")), "pw": split_words(F.col("pred"))})


def _joined(words: str, n: int) -> F.Column:
    return F.array_join(F.slice(words, 1, n), " ")


def _q(expr: str, name: str, base: str = PAIRS) -> str:
    return f"WITH p AS ({base}) SELECT conv_id, turn, {expr} AS {name} FROM p"


_THINK = "'<think>' || array_to_string(aw[1:3], ' ') || CASE WHEN turn % 3 = 0 THEN '' ELSE '</think> ' END || array_to_string(pw[1:4], ' ') || CASE WHEN turn % 4 = 1 THEN ' <think> x' ELSE '' END"


@query(_q(f"CASE WHEN contains(CASE WHEN contains(t, '</think>') THEN trim(split_part(t, '</think>', 2)) ELSE t END, '<think>') THEN 'Empty' ELSE CASE WHEN contains(t, '</think>') THEN trim(split_part(t, '</think>', 2)) ELSE t END END", "answer", f"SELECT conv_id, turn, {_THINK} AS t FROM ({PAIRS})"))
def g1_strip_thinking(spark, d):
    text = F.concat(F.lit("<think>"), _joined("aw", 3), F.when(F.col("turn") % 3 == 0, "").otherwise("</think> "), _joined("pw", 4), F.when(F.col("turn") % 4 == 1, " <think> x").otherwise(""))
    return pairs(spark, d).select("conv_id", "turn", A.strip_thinking(text).alias("answer"))


@query(_q(r"CASE WHEN turn % 2 = 1 THEN trim(array_to_string(pw[2:3], ' ')) ELSE trim(pred) END", "answer"))
def g2_extract_boxed(spark, d):
    text = F.when(F.col("turn") % 2 == 1, F.concat(_joined("aw", 2), F.lit(" \\boxed{ "), F.array_join(F.slice("pw", 2, 2), " "), F.lit(" } \\boxed{no}"))).otherwise(F.col("pred"))
    return pairs(spark, d).select("conv_id", "turn", A.extract_boxed(text).alias("answer"))


@query(_q(r"CASE WHEN turn % 2 = 1 THEN pw[1] || ' ' || pw[2] ELSE trim(regexp_extract(pred, '^([^\n]*)', 1)) END", "answer"))
def g3_extract_prefixed(spark, d):
    text = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("so\nANSWER: answer: "), _joined("pw", 2), F.lit("\nmore"))).otherwise(F.col("pred"))
    return pairs(spark, d).select("conv_id", "turn", A.extract_prefixed(text).alias("answer"))


@query(_q("CASE WHEN turn % 3 = 0 THEN NULL ELSE pw[1] || chr(10) || pw[2] END AS answer, CASE WHEN turn % 3 = 0 THEN 0 ELSE 2 END::BIGINT", "n_tags"))
def g4_extract_last_tag(spark, d):
    tagged = F.concat(F.lit("<answer>"), F.col("aw")[0], F.lit("</answer> or <answer> "), F.col("pw")[0], F.lit("\n"), F.col("pw")[1], F.lit("</answer>"))
    text = F.when(F.col("turn") % 3 == 0, F.col("pred")).otherwise(tagged)
    return pairs(spark, d).select("conv_id", "turn", A.extract_last_tag(text).alias("answer"), A.count_tags(text).alias("n_tags"))


@query(f"SELECT conv_id, turn, {norm('text')} AS answer FROM conversations")
def g5_normalize_answer(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", A.normalize_answer(F.col("text")).alias("answer"))


_GOLD = "[CASE WHEN turn % 2 = 1 THEN array_to_string(pw[1:3], ' ') ELSE aw[1] END, aw[2]]"


def golds() -> F.Column:
    return F.array(F.when(F.col("turn") % 2 == 1, _joined("pw", 3)).otherwise(F.col("aw")[0]), F.col("aw")[1])


@query(_q(f"({norm('g[1]')} = {norm('short')} OR {norm('g[2]')} = {norm('short')})::INT::DOUBLE AS em, (contains({norm('pred')}, {norm('g[1]')}) OR contains({norm('pred')}, {norm('g[2]')}))::INT::DOUBLE", "sub", f"SELECT *, array_to_string(pw[1:3], ' ') || '!' AS short, {_GOLD} AS g FROM ({PAIRS})"))
def g6_exact_and_substring_match(spark, d):
    short = F.concat(_joined("pw", 3), F.lit("!"))
    return pairs(spark, d).select("conv_id", "turn", A.exact_match(short, golds()).alias("em"), A.substring_match(F.col("pred"), golds()).alias("sub"))


@query(
    f"""WITH p AS ({PAIRS}), x AS (SELECT conv_id, turn, {norm("pred")} AS a, {norm("ask || ' ' || array_to_string(pw[1:2], ' ')")} AS b FROM p),
    u AS (SELECT conv_id, turn, 1 AS side, unnest(string_split(a, ' ')) AS w FROM x UNION ALL SELECT conv_id, turn, 2, unnest(string_split(b, ' ')) FROM x),
    c AS (SELECT conv_id, turn, w, sum((side = 1)::INT) AS na, sum((side = 2)::INT) AS nb FROM u WHERE w <> '' GROUP BY ALL),
    s AS (SELECT conv_id, turn, sum(least(na, nb)) AS common, sum(na) AS n_a, sum(nb) AS n_b FROM c GROUP BY ALL)
    SELECT conv_id, turn, round(CASE WHEN common = 0 THEN 0.0 ELSE 2.0 * (common / n_a) * (common / n_b) / (common / n_a + common / n_b) END, 6) AS f1 FROM s"""
)
def g7_token_f1(spark, d):
    gold = F.concat_ws(" ", "ask", _joined("pw", 2))
    return pairs(spark, d).select("conv_id", "turn", F.round(A.token_f1(F.col("pred"), F.array(gold)), 6).alias("f1"))


@query(
    f"""WITH p AS ({PAIRS}), x AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(regexp_replace(lower(pred), '[.,!?]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+'), lambda z: z <> '')) AS a,
      list_distinct(list_filter(string_split_regex(regexp_replace(lower(ask), '[.,!?]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+'), lambda z: z <> '')) AS b, pred, ask FROM p)
    SELECT conv_id, turn, round(CASE WHEN lower(pred) = lower(ask) THEN 1.0 WHEN len(list_intersect(a, b)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) END, 6) AS f1 FROM x"""
)
def g8_set_f1(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(A.set_f1(F.col("pred"), F.col("ask")), 6).alias("f1"))


_ORDERS = """lower_words AS (SELECT conv_id, turn, list_filter(string_split_regex(lower(pred), '[ \\t\\n\\r\\f\\v]+'), lambda z: z <> '') AS p, list_filter(string_split_regex(lower(ask), '[ \\t\\n\\r\\f\\v]+'), lambda z: z <> '') AS g FROM pairs),
n AS (SELECT unnest([1, 2, 3, 4]) AS n),
a AS (SELECT conv_id, turn, n, gram, count(*) AS c FROM (SELECT conv_id, turn, n, unnest(list_transform(range(1, len(p) - n + 2), lambda i: p[i:i + n - 1])) AS gram FROM lower_words CROSS JOIN n) GROUP BY ALL),
b AS (SELECT conv_id, turn, n, gram, count(*) AS c FROM (SELECT conv_id, turn, n, unnest(list_transform(range(1, len(g) - n + 2), lambda i: g[i:i + n - 1])) AS gram FROM lower_words CROSS JOIN n) GROUP BY ALL),
h AS (SELECT a.conv_id, a.turn, a.n, sum(least(a.c, coalesce(b.c, 0))) AS hit, sum(a.c) AS total FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.n = b.n AND a.gram = b.gram GROUP BY ALL),
o AS (SELECT w.conv_id, w.turn, n.n, ln((CASE WHEN coalesce(h.hit, 0) = 0 THEN 0.1 ELSE h.hit END) / greatest(1, coalesce(h.total, 0))) AS x, coalesce(h.hit, 0) AS hit, len(w.p) AS lp, len(w.g) AS lg FROM lower_words w CROSS JOIN n LEFT JOIN h ON h.conv_id = w.conv_id AND h.turn = w.turn AND h.n = n.n),
s AS (SELECT conv_id, turn, max(lp) AS lp, max(lg) AS lg, max(hit) FILTER (n = 1) AS hit, max(x) FILTER (n = 1) AS x1, max(x) FILTER (n = 2) AS x2, max(x) FILTER (n = 3) AS x3, max(x) FILTER (n = 4) AS x4 FROM o GROUP BY ALL)"""
_BLEU = ", ".join(f"round(CASE WHEN lp = 0 OR hit = 0 THEN 0.0 ELSE exp(least(0, 1 - lg / lp) + {x}) END, 6) AS bleu_{n}" for n, x in enumerate(("x1", "0.5 * x1 + 0.5 * x2", "0.33 * x1 + 0.33 * x2 + 0.33 * x3", "0.25 * x1 + 0.25 * x2 + 0.25 * x3 + 0.25 * x4"), 1))


@query(f"WITH pairs AS ({PAIRS}), {_ORDERS} SELECT conv_id, turn, {_BLEU} FROM s")
def g9_bleu(spark, d):
    return scoring.bleu(pairs(spark, d).select("conv_id", "turn", "pred", "ask"), pred="pred", gold="ask")


@query()
def g10_rouge_l(spark, d):
    return scoring.rouge_l(pairs(spark, d).select("conv_id", "turn", "pred", F.array("ask").alias("golds")), pred="pred", golds="golds")


@query(_q("round(len(list_filter(aw[1:5], lambda k: contains(lower(pred), lower(k)))) / len(aw[1:5]), 6)", "score"))
def g11_keyword_recall(spark, d):
    return pairs(spark, d).select("conv_id", "turn", F.round(A.keyword_recall(F.col("pred"), F.slice("aw", 1, 5)), 6).alias("score"))


@query(_q("contains(lower(pred), lower(aw[1]))::INT::DOUBLE", "score"))
def g12_containment(spark, d):
    return pairs(spark, d).select("conv_id", "turn", A.containment(F.col("pred"), F.col("aw")[0]).alias("score"))


@query(_q("CASE WHEN turn % 2 = 1 OR contains(gold, ';') THEN round(len(list_filter(list_transform(string_split(gold, ';'), lambda k: lower(trim(k))), lambda k: contains(pred, k))) / len(string_split(gold, ';')), 6) ELSE contains(lower(pred), lower(trim(gold)))::INT::DOUBLE END", "score", f"SELECT *, CASE WHEN turn % 2 = 1 THEN array_to_string(aw, '; ') ELSE aw[1] END AS gold FROM ({PAIRS})"))
def g13_multi_part_recall(spark, d):
    gold = F.when(F.col("turn") % 2 == 1, F.array_join("aw", "; ")).otherwise(F.get("aw", F.lit(0)))
    return pairs(spark, d).select("conv_id", "turn", F.round(A.multi_part_recall(F.col("pred"), gold), 6).alias("score"))


@query(_q("(turn % 4 = 1 AND conv_id % 3 = 0)::INT::DOUBLE", "score"))
def g14_strict_integer_label(spark, d):
    said = F.concat(F.lit("so \\boxed{'"), F.when(F.col("turn") % 4 == 1, F.col("conv_id").cast("string")).otherwise(F.lit("x")), F.lit("'}"))
    gold = F.when(F.col("conv_id") % 3 == 0, F.col("conv_id")).otherwise(F.col("conv_id") + 1).cast("string")
    return pairs(spark, d).select("conv_id", "turn", A.strict_integer_label(said, gold).alias("score"))


@query(_q("round(CASE WHEN conv_id % 5 = 0 THEN 0.0 WHEN lower(aw[1]) <> lower(pw[1]) AND turn % 3 = 0 THEN 0.0 WHEN turn % 3 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 1.0 ELSE 0.8 END ELSE CASE WHEN conv_id % 2 = 0 THEN 1.0 ELSE 0.8 END END::DOUBLE, 6)", "score", f"SELECT * FROM ({PAIRS}) WHERE NOT contains(aw[1] || pw[1], '>')"))
def g15_hierarchical_label(spark, d):
    head = F.when(F.col("turn") % 3 == 0, F.col("aw")[0]).otherwise(F.col("pw")[0])
    gold = F.concat_ws(" > ", F.col("pw")[0], F.lit("B"), F.lit("c"))
    said = F.when(F.col("conv_id") % 5 == 0, F.concat_ws(" > ", head, F.lit("b"))).otherwise(F.concat_ws(">", head, F.lit("b"), F.when(F.col("conv_id") % 2 == 0, "C").otherwise("d")))
    base = pairs(spark, d).where(~F.contains(F.concat(F.col("aw")[0], F.col("pw")[0]), F.lit(">")))
    return base.select("conv_id", "turn", F.round(A.hierarchical_label(said, gold), 6).alias("score"))


@query(_q("(contains(lower(pred), lower(aw[1])) AND contains(lower(pred), lower(aw[2])))::INT::DOUBLE AS every, round((contains(lower(pred), lower(aw[1]))::INT + contains(lower(pred), lower(aw[2]))::INT) / 2, 6)", "share"))
def g16_elements_found(spark, d):
    both = F.slice("aw", 1, 2)
    return pairs(spark, d).select("conv_id", "turn", A.all_elements_found(F.col("pred"), both).alias("every"), F.round(A.keyword_recall(F.col("pred"), both), 6).alias("share"))


@query(_q("(contains(lower(pred), lower(aw[1])) OR contains(lower(pw[1]), lower(aw[1])))::INT::DOUBLE", "score"))
def g17_option_match(spark, d):
    return pairs(spark, d).select("conv_id", "turn", A.option_match(F.col("pred"), F.col("pw")[0], F.col("aw")[0]).alias("score"))


#: Every third answer is no numbered list: commas part it.
@query(
    """WITH n AS (SELECT DISTINCT source AS name FROM documents),
    q AS (SELECT doc_id, source AS gold, unnest([1, 2, 3]) AS rank, unnest(['Src' || (doc_id % 20), source || 'x', 'src' || ((doc_id + 7) % 20)]) AS item FROM documents),
    m AS (SELECT doc_id, gold, rank, (SELECT arg_min(name, [levenshtein(lower(item), lower(name))::VARCHAR, name]) FROM n) AS name FROM q)
    SELECT doc_id, max((rank <= 1 AND name = gold)::INT)::DOUBLE * 2 / 3 AS recall_1, max((rank <= 5 AND name = gold)::INT)::DOUBLE * 2 / 3 AS recall_5, max((rank <= 10 AND name = gold)::INT)::DOUBLE * 2 / 3 AS recall_10 FROM m GROUP BY doc_id"""
)
def g18_recall_at_k(spark, d):
    docs = table(spark, d, "documents")
    one, two, three = F.concat(F.lit("Src"), F.col("doc_id") % 20), F.concat("source", F.lit("x")), F.concat(F.lit("src"), (F.col("doc_id") + 7) % 20)
    listed = F.concat(F.lit("Sure.\n1. "), one, F.lit(" (best)\n2. "), two, F.lit("\n3)- "), three)
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(one, F.lit(", "), two, F.lit(" (a), "), three)).otherwise(listed)
    names = docs.select(F.col("source").alias("name")).distinct()
    return scoring.recall_at_k(docs.select("doc_id", text.alias("answer"), F.array("source", "source", F.lit("none")).alias("golds")), names, key="doc_id")


#: A turn's words as its labels, all of them, each meant as the nation of nearest name; every fifth turn says no list.
@query(
    r"""WITH n AS (SELECT DISTINCT n_name AS name FROM nation), k AS (SELECT n_nationkey AS i, n_name AS name FROM nation),
    t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM conversations WHERE turn % 5 <> 0),
    u AS (SELECT conv_id, turn, unnest(w) AS item FROM t), d AS (SELECT DISTINCT item FROM u),
    b AS (SELECT item, name, row_number() OVER (PARTITION BY item ORDER BY levenshtein(lower(item), lower(name)), name) AS r FROM d CROSS JOIN n),
    p AS (SELECT conv_id, turn, list(b.name) AS named FROM u JOIN b USING (item) WHERE r = 1 GROUP BY ALL),
    g AS (SELECT conv_id, turn, [a.name, b.name, c.name] AS golds FROM conversations JOIN k a ON a.i = conv_id % 25 JOIN k b ON b.i = (conv_id + 3) % 25 JOIN k c ON c.i = 5),
    c AS (SELECT g.conv_id, g.turn, len(list_intersect(named, golds)) / len(named) AS a, len(list_intersect(named, golds)) / len(golds) AS r FROM g LEFT JOIN p USING (conv_id, turn))
    SELECT conv_id, turn, round(coalesce(2 * a * r / (a + r + 1e-5), 0), 6) AS f1 FROM c"""
)
def g19_set_label_f1(spark, d):
    nation = table(spark, d, "nation")
    by_key = F.broadcast(nation.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("long"), "n_name"))).alias("k")))  # 25 names
    rows = table(spark, d, "conversations").crossJoin(by_key)
    name = lambda i: F.element_at("k", i.cast("long"))
    said = F.when(F.col("turn") % 5 == 0, F.col("text")).otherwise(F.to_json(split_words(F.col("text"))))
    golds = F.array(name(F.col("conv_id") % 25), name((F.col("conv_id") + 3) % 25), name(F.lit(5)))
    out = scoring.label_f1(rows.select(F.struct("conv_id", "turn").alias("k"), said.alias("said"), golds.alias("golds")), nation.select(F.col("n_name").alias("name")), key="k")
    return out.select("k.conv_id", "k.turn", F.round("f1", 6).alias("f1"))


@query(_q(f"CASE WHEN turn % 3 = 0 THEN 0.0 ELSE 1.0 + CASE WHEN {norm('aw[1]')} = {norm('pw[1]')} THEN 1.0 ELSE 0.0 END END::DOUBLE", "score", f"SELECT * FROM ({PAIRS}) WHERE regexp_full_match(aw[1] || pw[1], '[A-Za-z]+')"))
def g20_multi_objective_score(spark, d):
    said = F.concat(F.lit("<answer>same; "), F.col("pw")[0], F.when(F.col("turn") % 3 == 0, "; extra").otherwise(""), F.lit("</answer>"))
    base = pairs(spark, d).where(F.concat(F.col("aw")[0], F.col("pw")[0]).rlike("^[A-Za-z]+$"))
    return base.select("conv_id", "turn", A.multi_objective_score(said, F.concat(F.lit("Same;"), F.col("aw")[0])).alias("score"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 0.0 WHEN turn % 3 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS strict, CASE WHEN turn % 3 = 1 THEN 1.0 WHEN turn % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS flexible FROM conversations")
def g21_number_answer_score(spark, d):
    n = (F.col("conv_id") * 1000 + F.col("turn")).cast("string")
    commas = F.concat((F.col("conv_id") + 1).cast("string"), F.lit(","), F.lit("000"))
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("it is "), n, F.lit("."))).when(F.col("turn") % 3 == 1, F.concat(F.lit("7 so #### "), commas)).otherwise("#### 5")
    gold = F.when(F.col("turn") % 3 == 1, ((F.col("conv_id") + 1) * 1000).cast("string")).when(F.col("turn") % 3 == 0, n).otherwise("6")
    return table(spark, d, "conversations").select("conv_id", "turn", A.number_answer_score(text, gold).alias("strict"), A.number_answer_score(text, gold, strict=False).alias("flexible"))


@query(_q(f"CASE WHEN turn % 3 = 0 THEN 0.0 ELSE (contains({norm('pred')}, {norm('aw[1]')}))::INT::DOUBLE / CASE WHEN turn % 3 = 1 THEN 1 ELSE 4 END END", "score"))
def g22_tag_em_score(spark, d):
    more = F.when(F.col("turn") % 3 == 2, F.repeat(F.lit("<answer>x</answer>"), 10)).otherwise("")
    text = F.when(F.col("turn") % 3 == 0, F.col("pred")).otherwise(F.concat(more, F.lit("<answer>"), F.col("pred"), F.lit("</answer>")))
    return pairs(spark, d).select("conv_id", "turn", A.tag_em_score(text, F.slice("aw", 1, 1), substring=True).alias("score"))


@query(_q("CASE WHEN turn % 4 = 1 THEN 1.0 ELSE 0.0 END::DOUBLE", "score"))
def g24_parse_judge_label(spark, d):
    said = F.when(F.col("turn") % 4 == 1, "CORRECT").when(F.col("turn") % 4 == 3, "CORRECT or WRONG").otherwise("none")
    return pairs(spark, d).select("conv_id", "turn", A.parse_judge_label(said).alias("score"))


def parts(pred: str, gold: str) -> str:
    """The SQL of multi_part_recall."""
    several = f"len(list_filter(list_transform(string_split({gold}, ';'), lambda x: lower(trim(x))), lambda x: contains({pred}, x))) / len(string_split({gold}, ';'))"
    return f"CASE WHEN contains({gold}, ';') THEN {several} ELSE contains(lower({pred}), lower(trim({gold})))::INT::DOUBLE END"


RESULTS = r"""
SELECT d.doc_id, d.source, l.quality, string_split_regex(trim(d.text), '[ \t\n\r\f\v]+') AS w,
  CASE d.doc_id % 4 WHEN 0 THEN 'keywords' WHEN 1 THEN 'contains' WHEN 2 THEN 'parts' ELSE 'judged' END AS data_source
FROM documents d JOIN labels l USING (doc_id)
"""


def results(spark, d) -> DataFrame:
    """Results with golds, predictions and, for judged sources, a judge's words."""
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("keywords", "contains", "parts", "judged")]), (F.col("doc_id") % 4 + 1).cast("int"))
    base = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("w", split_words(F.col("text")))
    return base.select(
        "doc_id",
        "source",
        "quality",
        kinds.alias("data_source"),
        F.array_join(F.slice("w", 1, 6), " ").alias("pred"),
        F.when(F.col("doc_id") % 4 == 0, F.array_join(F.slice("w", 5, 4), ", ")).otherwise(F.col("w")[0]).alias("gold"),
        F.when(F.col("quality") == 1, "Yes").otherwise("no, yes").alias("judge"),
    )


SCORED = f"""
WITH r AS ({RESULTS}), g AS (SELECT *, array_to_string(w[1:6], ' ') AS pred, CASE WHEN doc_id % 4 = 0 THEN array_to_string(w[5:8], ', ') ELSE w[1] END AS gold FROM r)
SELECT doc_id, source, data_source, pred, gold, round(CASE data_source
  WHEN 'keywords' THEN len(list_filter(string_split(gold, ', '), lambda k: contains(lower(pred), lower(k)))) / len(string_split(gold, ', '))
  WHEN 'contains' THEN contains(lower(pred), lower(gold))::INT::DOUBLE
  WHEN 'parts' THEN {parts('pred', 'gold')}
  ELSE (quality = 1)::INT::DOUBLE END, 6) AS score FROM g
"""


@query(f"SELECT doc_id, data_source, score FROM ({SCORED})")
def g23_score_results(spark, d):
    return scoring.score_results(results(spark, d)).select("doc_id", "data_source", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN score ELSE 0.25 END AS score FROM ({SCORED})")
def g25_rescore(spark, d):
    rows = scoring.score_results(results(spark, d)).withColumnRenamed("score", "new")
    rows = rows.withColumn("score", F.when(F.col("doc_id") % 3 != 0, 0.25))
    return scoring.rescore(rows, new=F.round("new", 6)).select("doc_id", "score")


@query(_q(f"CASE WHEN contains({norm('pred')}, {norm('aw[1]')}) THEN 1.0 WHEN {norm('aw[1]')} = {norm('pw[1]')} THEN 1.0 ELSE 0.0 END::DOUBLE", "score"))
def g26_max_raw_parsed(spark, d):
    gold = F.slice("aw", 1, 1)
    return scoring.max_raw_parsed(pairs(spark, d), {"score": lambda t: A.substring_match(t, gold)}, raw="pred").select("conv_id", "turn", "score")
