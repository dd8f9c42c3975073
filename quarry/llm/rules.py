"""Quality rules as weak supervision, in built-in functions only.

Nine rules look at a text's statistics; each votes good (1) or bad (-1) or abstains (0). A text is of
one of four kinds: good, or bad by junk symbols, by repetition or by shouting. Expectation-maximisation
over the counts of the vote patterns (at most 3^9 of them, whatever the corpus) estimates how common each
kind is and how often each rule votes bad on texts of each kind; a text's verdict is its posterior
probability of being good, instead of all-rules-must-pass. Within one bad kind the rules that see its
fault depend on one another, which a single bad class would not allow. A rule that also votes bad on
good texts is outvoted, and votes that are weak one by one can reject a text together. The counts are a
partial aggregate, the iterations one expression over the array of patterns, and the verdicts an
equi-join on the pattern with a table of that bounded size.

Defined results: a null or empty text has no words, so it fails the base rules; repeated rows and
ties get equal verdicts; a null id stays null; an empty table gives an empty result. Windows of
words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACES = " \t\n\x0b\x0c\r"
ROUNDS = 20
N_RULES = 9
#: the rules that see the fault of each bad kind
KINDS = ((0, 1, 2), (3, 4, 5), (6, 7, 8))
#: where the iterations start: the share of good texts; how often a rule votes bad where nothing is wrong for it, and
#: on the fault that it sees. As many votes as SMOOTH keep the estimates near the start, so none is 0 or 1.
PRIOR, MISFIRE, SEES, SMOOTH = 0.9, 0.05, 0.7, 4.0


def _without(chars: str) -> Column:
    return F.length(F.translate("text", chars, ""))


def _lambda_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def statistics(docs: DataFrame) -> DataFrame:
    """Adds to the documents (`text` never null) the columns that contract and rules use."""
    d = docs.withColumns({
        "_w": F.transform(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""), lambda x: F.xxhash64(x)),
        "_l": F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, SPACES, "") != ""),
        "n_chars_": F.length("text").cast("long"),
        "word_chars": _without(SPACES).cast("long"),
        "n_symbols": (F.length("text") - _without("#*$%&|<>")).cast("long"),
        "n_upper": (F.length("text") - _without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long"),
        "n_stops": (F.length("text") - _without(".!?")).cast("long"),
    })
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "n_distinct": F.size(F.array_distinct("_w")).cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "_g": F.when(F.size("_w") >= 8, F.transform(F.sequence(F.lit(1), F.size("_w") - 7), lambda i: F.xxhash64(F.slice("_w", i, 8)))),
    })
    # only texts in which some window repeats are sorted: equal windows become neighbours
    repeats = F.size(F.array_distinct("_g")) < F.size("_g")
    d = d.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hash_at = lambda k: F.get(F.col("_s"), k)["h"]
    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda k: F.coalesce(hash_at(k) == hash_at(k - 1), F.lit(False)) | F.coalesce(hash_at(k) == hash_at(k + 1), F.lit(False)))
    d = d.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.transform(twice, lambda k: F.get(F.col("_s"), k)["i"]))))
    # each repeated window covers eight words, less where the next one starts sooner
    steps = F.transform("_p", lambda x, j: F.least(F.lit(8), F.coalesce(F.get(F.col("_p"), j + 1), x + 8) - x).cast("long"))
    d = d.withColumn("n_repeat_words", F.when(F.size("_p") > 0, _lambda_sum(steps)).otherwise(F.lit(0)).cast("long"))
    return d.drop("_w", "_l", "_g", "_s", "_p")


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> list[Column]:
    """Of symbols (by characters, by words) and word length; of repeated windows, distinct words and
    repeated lines; of some and of mostly capitals, and of sentence ends."""
    c = F.col
    n, chars = c("n_words"), c("word_chars")
    return [
        _vote(c("n_symbols") * 300 < c("n_chars_"), c("n_symbols") * 50 > c("n_chars_")),
        _vote(c("n_symbols") * 20 < n, c("n_symbols") * 5 > n),
        _vote((chars >= n * 4) & (chars * 2 <= n * 13), (chars < n * 3) | (chars > n * 7)),
        _vote(c("n_repeat_words") * 20 < n, c("n_repeat_words") * 5 > n),
        _vote(c("n_distinct") * 2 > n, c("n_distinct") * 5 < n * 2),
        _vote(c("n_dup_lines") == 0, c("n_dup_lines") * 10 > c("n_lines") * 3),
        _vote(c("n_upper") * 12 < chars, c("n_upper") * 4 > chars),
        _vote(c("n_upper") * 8 < chars, c("n_upper") * 2 > chars),
        _vote((c("n_stops") * 40 >= n) & (c("n_stops") * 5 <= n), (c("n_stops") * 200 < n) | (c("n_stops") * 2 > n)),
    ]


def code() -> Column:
    """The pattern of the votes as one number in base 3, doubled, plus 1 if the base rules fail."""
    total = F.lit(0)
    for v in votes():
        total = total * 3 + (v + 1)
    # never null, so that the join below adds no null test to push into the statistics
    return F.coalesce((total * 2 + base_failed().cast("int")).cast("int"), F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def _start() -> list[list[float]]:
    return [[SEES if j in kind else MISFIRE for j in range(N_RULES)] for kind in ((), *KINDS)]


def posteriors(coded: DataFrame) -> DataFrame:
    """(code int) of all texts -> (code, base_failed, posterior, kept): one row for each code that occurs."""
    kinds, rules = f"sequence(0, {len(KINDS)})", f"sequence(0, {N_RULES - 1})"
    counts = coded.groupBy("code").agg(F.count("*").cast("double").alias("n"))
    digits = F.expr(f"transform({rules}, j -> cast(floor(floor(code / 2) / power(3, {N_RULES - 1} - j)) as int) % 3 - 1)")
    one = counts.agg(F.sort_array(F.collect_list(F.struct("code", "n", digits.alias("v"), (F.col("code") % 2 == 1).alias("failed")))).alias("patterns")).where(F.size("patterns") > 0)
    start = "array(" + ", ".join("array(" + ", ".join(f"{x}D" for x in row) + ")" for row in _start()) + ")"
    state = f"named_struct('prior', array({', '.join(f'{x}D' for x in _priors())}), 'bad', {start})"
    # how likely each kind is with a pattern; abstaining says nothing
    joint = f"transform({kinds}, k -> s.prior[k] * exp(aggregate({rules}, 0D, (t, j) -> t + CASE p.v[j] WHEN -1 THEN ln(s.bad[k][j]) WHEN 1 THEN ln(1 - s.bad[k][j]) ELSE 0D END)))"
    shares = f"transform(array({joint}), q -> transform(q, x -> x / aggregate(q, 0D, (t, y) -> t + y)))[0]"
    post = f"transform(transform(patterns, p -> named_struct('v', p.v, 'n', p.n, 'q', {shares})), p -> named_struct('v', p.v, 'w', transform(p.q, x -> x * p.n)))"
    total = "aggregate(post, 0D, (t, p) -> t + p.w[k]{})"
    bad = f"({total.format(' * if(p.v[j] = -1, 1D, 0D)')} + {SMOOTH}D * start[k][j]) / ({total.format(' * if(p.v[j] <> 0, 1D, 0D)')} + {SMOOTH}D)"
    step = f"named_struct('prior', transform({kinds}, k -> ({total.format('')} + 1D) / (total + {len(KINDS) + 1}D)), 'bad', transform({kinds}, k -> transform({rules}, j -> {bad})))"
    one = one.withColumn("start", F.expr(start)).withColumn("total", F.expr("aggregate(patterns, 0D, (t, p) -> t + p.n)"))
    one = one.withColumn("s", F.expr(f"aggregate(sequence(1, {ROUNDS}), {state}, (s, i) -> transform(array({post}), post -> {step})[0])"))
    found = one.select("s", F.explode("patterns").alias("p")).select("p.code", F.col("p.failed").alias("base_failed"), F.expr(f"{shares}[0]").alias("posterior"))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def _priors() -> list[float]:
    return [PRIOR, *[(1 - PRIOR) / len(KINDS)] * len(KINDS)]


def judge(stats: DataFrame) -> DataFrame:
    """Adds base_failed, posterior and kept to what statistics() gives. The verdicts come from the table's
    side of the join and are no function of its key, so no filter on them is pushed into the
    statistics, where every expression would be inlined and computed again. The counts and the join read
    `stats` once each: have it written before (checkpoint()) unless it is cheap."""
    return _verdicts(stats.withColumn("code", code())).drop("code")


def _verdicts(coded: DataFrame) -> DataFrame:
    return coded.join(F.broadcast(posteriors(coded.select("code"))), "code")  # at most 2 * 3^9 rows


def query(spark, sf_dir: str) -> DataFrame:
    common.ensure_checkpoint_dir(spark)
    stats = statistics(common.texts(common.table(spark, sf_dir, "documents"))).drop("text").checkpoint()
    return judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without those that the rules reject. The rows are written once with
    their vote patterns, so the statistics are computed once."""
    common.ensure_checkpoint_dir(docs.sparkSession)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    own = docs.select(row, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _verdicts(statistics(own).select("_row", code().alias("code")).checkpoint()).where("kept").select("_row.*")


def _sql() -> str:
    v = [f"CASE WHEN {b} THEN -1 WHEN {g} THEN 1 ELSE 0 END" for g, b in [
        ("n_symbols * 300 < n_chars", "n_symbols * 50 > n_chars"),
        ("n_symbols * 20 < n_words", "n_symbols * 5 > n_words"),
        ("word_chars >= n_words * 4 AND word_chars * 2 <= n_words * 13", "word_chars < n_words * 3 OR word_chars > n_words * 7"),
        ("n_repeat_words * 20 < n_words", "n_repeat_words * 5 > n_words"),
        ("n_distinct * 2 > n_words", "n_distinct * 5 < n_words * 2"),
        ("n_dup_lines = 0", "n_dup_lines * 10 > n_lines * 3"),
        ("n_upper * 12 < word_chars", "n_upper * 4 > word_chars"),
        ("n_upper * 8 < word_chars", "n_upper * 2 > word_chars"),
        ("n_stops * 40 >= n_words AND n_stops * 5 <= n_words", "n_stops * 200 < n_words OR n_stops * 2 > n_words"),
    ]]
    vs = ", ".join(f"v{j}" for j in range(N_RULES))
    start = ", ".join(f"({k}, {j}, {x}::DOUBLE, {prior}::DOUBLE)" for (k, row), prior in zip(enumerate(_start()), _priors()) for j, x in enumerate(row))
    joint = lambda i: f"j{i} AS MATERIALIZED (SELECT pid, k, n, any_value(prior) * exp(sum(CASE v WHEN -1 THEN ln(bad) WHEN 1 THEN ln(1 - bad) ELSE 0 END)) AS q FROM long JOIN s{i} USING (j) GROUP BY pid, k, n)"
    share = lambda i: f"p{i} AS MATERIALIZED (SELECT pid, k, n, q / sum(q) OVER (PARTITION BY pid) AS y FROM j{i})"
    rounds = []
    for i in range(ROUNDS):
        rounds += [joint(i), share(i), f"""s{i + 1} AS MATERIALIZED (SELECT k, j, (sum(CASE WHEN v = -1 THEN n * y ELSE 0 END) + {SMOOTH} * any_value(first)) / (sum(CASE WHEN v <> 0 THEN n * y ELSE 0 END) + {SMOOTH}) AS bad,
  (sum(n * y) + 1) / (sum(n) + {len(KINDS) + 1}) AS prior FROM p{i} JOIN long USING (pid, n) JOIN (SELECT k, j, bad AS first FROM s0) USING (k, j) GROUP BY k, j)"""]
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS t(i)),
rep AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM win JOIN rep USING (doc_id, g), range(8) AS r(j) GROUP BY doc_id),
st AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(text) AS n_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
  length(regexp_replace(text, '[^.!?]', '', 'g')) AS n_stops,
  len(list_distinct(ws)) AS n_distinct, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
vt AS MATERIALIZED (SELECT *, {", ".join(f"{x} AS v{j}" for j, x in enumerate(v))} FROM st),
pats AS MATERIALIZED (SELECT {vs}, count(*)::DOUBLE AS n, row_number() OVER () AS pid FROM vt GROUP BY {vs}),
long AS MATERIALIZED ({" UNION ALL ".join(f"SELECT pid, n, {j} AS j, v{j} AS v FROM pats" for j in range(N_RULES))}),
s0(k, j, bad, prior) AS MATERIALIZED (VALUES {start}),
{", ".join(rounds)}, {joint(ROUNDS)}, {share(ROUNDS)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND y >= 0.5 AS kept FROM vt JOIN pats USING ({vs}) JOIN p{ROUNDS} USING (pid) WHERE k = 0
"""


SQL = _sql()
