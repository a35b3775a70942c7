"""Operator 9: chat formatting by quotation linking.

1. Each message is read line by line: leading > marks give a line's quote level; the others are its own. Lines of one
   level that follow each other are a passage.
2. A quoted passage is normalised (lower case, blanks and line ends to single blanks) and hashed: whole, by sentences, by pairs of
   sentences that follow each other, and by lines. So are the own passages of earlier messages of the conversation, and
   equal hashes join them. A message that quotes only a part, or wraps the lines anew, still shares sentences.
3. A passage comes from the latest earlier message that has it whole; else, of all earlier ones, from the one with the most words in common
   pairs, then in common sentences or lines; then the latest. Hashes of at most RARE messages name all of them; of a more frequent one the latest and the
   first are candidates. Where a message that has frequent hashes only could be better than the best of these, all holders of the passage's
   frequent hashes are scored, once for each set of such hashes, and the best before each quote is a running maximum.
4. A message replies to the message that its outermost passages come from; of several the one with the most quoted words,
   then the latest. Following replies to their start (pointer doubling) gives each message its thread and depth.
5. Messages without their quotes, ordered by conversation, thread and turn: a reply always follows what it
   replies to.

A line that half the messages of a conversation repeat meets its quotes by ranges of SPAN turns, each range its own group. No
message meets all messages that share a line with it. Nothing is gathered by conversation, so one may hold any share of the rows.

Only built-in functions.

Defined results: a null text is empty and links to nothing; null or repeated (conversation, turn) keys are
rows of their own, each with its own quotes; messages of one turn do not quote each other; replies to a turn of several messages go on by
the one of them with the most quoted words, then with the latest origin; a null conversation or turn is never linked; \\r and \\r\\n end a line as \\n does, which
is what texts have between lines; quotes of passages that no earlier message has stay unlinked and are removed all the same; blank lines
inside a message are kept, leading and trailing ones are not where quotes are removed; an empty table gives no rows; other columns
of the input are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut, row_id, with_totals

#: A quoted line: up to three blanks, then > marks with at most one blank after each (fixed value). Possessive: a line may have a million marks.
QUOTE = r"^ {0,3}(?:> ?)++"
#: A line that only announces a quote, such as "On Monday, Ann wrote:" (fixed value).
ATTRIBUTION = r"^(?:On|Am|Le|El)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\s?:\s*\z"
#: Turns that one group of equal hashes spans; messages of a conversation that may have a hash for it to name them all.
SPAN, RARE = 256, 32
_MARK, _END = "\x1e", "\x1f"
LINE, SENTENCE, PAIR, WHOLE = 0, 1, 2, 3


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{00A0}\x1e\x1f]+", " "))


def parsed(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, r1, r2, lines): lines are (i, level, body); level 0 is the message's own. (r1, r2) tells rows apart."""
    lines = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r\n?", "\n"), "\n", -1)

    def line(x, i):
        marks = F.regexp_extract(x, QUOTE, 0)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(i.alias("i"), level.alias("level"), x.substr(F.length(marks) + 1, F.length(x)).alias("body"))

    r1, r2 = row_id(messages, conv, turn, role, text)
    return messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), r1.alias("r1"), r2.alias("r2"), F.transform(lines, line).alias("lines"))


def passages(parts: DataFrame) -> DataFrame:
    """(conv, turn, r1, r2, k, level, body): the k-th passage of a message, as it stands but for its marks."""
    def marked(x, i):
        first = (i == 0) | (F.get("lines", i - 1)["level"] != x["level"])
        head = F.when(first, F.concat(F.lit(_MARK), x["level"].cast("string"), F.lit(_END))).otherwise(F.lit(""))
        return F.concat(head, F.translate(x["body"], _MARK + _END, "  "))

    whole = F.array_join(F.transform("lines", marked), "\n")
    runs = F.filter(F.split(whole, _MARK), lambda x: x != "")
    rows = parts.where("conv is not null and turn is not null").select("conv", "turn", "r1", "r2", F.posexplode(runs).alias("k", "run"))
    at = F.instr("run", _END)
    return rows.select("conv", "turn", "r1", "r2", "k", F.substring_index("run", _END, 1).cast("int").alias("level"), F.expr("substring(run, instr(run, '\x1f') + 1)").alias("body")).where(at > 0)


def units(found: DataFrame) -> DataFrame:
    """`found` (..., body) as (..., total, grain, h, h2, n): the hashes of the passage's parts, n words each; total is all its words."""
    def words(x):
        return F.size(F.split(x, " "))

    rows = found.select(*[c for c in found.columns if c != "body"], _normal(F.col("body")).alias("whole"), F.filter(
        F.transform(F.split("body", "\n"), _normal), lambda x: x != "").alias("lines")).where("whole <> ''")
    rows = rows.withColumn("said", F.split(F.regexp_replace("whole", r"([.!?]) ", "$1\n"), "\n"))
    pairs = F.transform(F.slice("said", F.lit(2), F.size("said")), lambda x, i: F.concat(F.get("said", i), F.lit(" "), x))
    parts = [(LINE, F.array_distinct("lines")), (SENTENCE, F.array_distinct("said")), (PAIR, F.array_distinct(pairs)), (WHOLE, F.array("whole"))]

    def hashed(grain, of):
        return F.transform(of, lambda u: F.struct(F.lit(grain).alias("grain"), F.xxhash64(F.lit(1), u).alias("h"), F.xxhash64(F.lit(2), u).alias("h2"), words(u).alias("n")))

    every = F.concat(*[hashed(*x) for x in parts])
    keep = [c for c in found.columns if c != "body"]
    return rows.select(*keep, words(F.col("whole")).alias("total"), F.inline(every))


_KEY = ["conv", "h", "h2"]
_PASSAGE = ["conv", "turn", "r1", "r2", "k", "level", "total"]


def holders(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """Rows of `quoted` (conv, turn, h, h2, ...) with the latest and the first earlier message of `own` (conv, turn, h, h2) that has the
    hash; no row where there is none."""
    span = F.floor(F.col("turn") / SPAN)
    wanted = quoted.select(*_KEY, span.alias("span")).distinct()
    own = own.join(wanted.select(*_KEY).distinct(), _KEY, "left_semi").select(*_KEY, "turn", span.alias("span")).distinct()
    both = own.unionByName(wanted.withColumn("turn", F.lit(None).cast(dict(own.dtypes)["turn"])))
    spans = both.groupBy(*_KEY, "span").agg(F.collect_set("turn").alias("turns"), F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    before = Window.partitionBy(*_KEY).orderBy("span")
    spans = spans.select(F.struct(*_KEY, "span").alias("at"), "turns", F.max("hi").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
                         F.min("lo").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("first"))
    met = quoted.join(spans, F.struct(*[quoted[c] for c in _KEY], F.floor(quoted["turn"] / SPAN).alias("span")) == F.col("at"))
    latest = F.coalesce(F.array_max(F.filter("turns", lambda t: t < F.col("turn"))), F.col("before"))
    return met.select(*quoted.columns, latest.alias("latest"), "first").where("first < turn")


def _score(votes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n2, words): the words of common pairs, and of common lines or sentences, whichever has more."""
    of = lambda g: F.sum(F.when(F.col("grain") == g, F.col("n")).otherwise(0))
    return votes.groupBy(*by).agg(of(PAIR).alias("n2"), F.greatest(of(LINE), of(SENTENCE)).alias("words"))


def _of_all_holders(own: DataFrame, frequent: DataFrame, open_: DataFrame) -> DataFrame:
    """(passage, best): the best earlier message by the frequent hashes of each open passage, all holders of them tried.

    Passages of one conversation with the same set of frequent hashes are tried together. Ranges of SPAN turns are groups of their own."""
    listed = frequent.join(open_.select(*_PASSAGE), _PASSAGE, "left_semi").select(*_PASSAGE, F.struct("grain", "h", "h2", "n").alias("u"))
    sets = cut(listed.groupBy(*_PASSAGE).agg(F.array_sort(F.collect_set("u")).alias("us")).withColumns({"s1": F.xxhash64(F.lit(1), "us"), "s2": F.xxhash64(F.lit(2), "us")}))
    key = ["conv", "s1", "s2"]
    units_of = sets.groupBy(*key).agg(F.first("us").alias("us")).select(*key, F.inline("us"))
    scored = _score(units_of.join(own.withColumnRenamed("turn", "m"), _KEY), [*key, "m"])
    rows = scored.select(*key, F.col("m").alias("turn"), F.struct("n2", "words", F.col("m").alias("origin")).alias("b"))
    asked = sets.select(*key, "turn").distinct().withColumn("b", F.lit(None).cast(dict(rows.dtypes)["b"]))
    every = cut(rows.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True))).withColumn("span", F.floor(F.col("turn") / SPAN)))
    inside = Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    most = every.groupBy(*key, "span").agg(F.max("b").alias("most"))
    most = most.select(F.struct(*key, "span").alias("at"), F.max("most").over(Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    best = every.withColumn("here", F.max("b").over(inside)).where("asked").join(most, F.struct(*key, "span") == F.col("at"))
    best = best.select(*key, "turn", F.greatest("here", "before").alias("b"))
    return sets.select(*_PASSAGE, "s1", "s2").join(best, [*key, "turn"]).select(*_PASSAGE, "b").where("b is not null")


def origins(own: DataFrame, quoted: DataFrame) -> DataFrame:
    """(passage, words, origin): the earlier message that each quoted passage comes from.

    own: (conv, turn, h, h2) of messages; quoted: units() of quoted passages."""
    own = cut(own.join(quoted.select(*_KEY).distinct(), _KEY, "left_semi").distinct())
    held = own.groupBy(*_KEY).agg(F.count("*").alias("holders")).withColumn("key", F.struct(*_KEY)).select("key", "holders")
    known = cut(with_totals(quoted.withColumn("key", F.struct(*_KEY)), held, "key").drop("key"))
    whole = holders(own, known.where(F.col("grain") == WHOLE).select(*_PASSAGE, "h", "h2")).select(*_PASSAGE, F.col("total").cast("long").alias("words"), F.col("latest").alias("origin"))
    whole = cut(whole)
    rest = cut(known.where(F.col("grain") != WHOLE).join(whole.select(*_PASSAGE), _PASSAGE, "left_anti"))
    rare, frequent = rest.where(F.col("holders") <= RARE), rest.where(F.col("holders") > RARE)
    rare = rare.join(own.withColumnRenamed("turn", "origin"), _KEY).where("origin < turn").select(*_PASSAGE, "origin", "grain", "n")
    met = cut(holders(own, frequent.select(*_PASSAGE, "grain", "h", "h2", "n")))
    ends = met.select(*_PASSAGE, F.explode(F.array("latest", "first")).alias("origin"))
    candidates = rare.select(*_PASSAGE, "origin").unionByName(ends).distinct()
    also = met.join(candidates, _PASSAGE).join(own.withColumnRenamed("turn", "origin"), [*_KEY, "origin"], "left_semi")
    best = _score(rare.unionByName(also.select(*_PASSAGE, "origin", "grain", "n")), [*_PASSAGE, "origin"])
    best = cut(best.groupBy(*_PASSAGE).agg(F.max(F.struct("n2", "words", "origin")).alias("b")))
    # No message that is no candidate has more than all frequent hashes, and one that has them all is no later than the latest holder of each.
    bound = _score(met, _PASSAGE).join(met.groupBy(*_PASSAGE).agg(F.min("latest").alias("upto")), _PASSAGE)
    mine, most = F.struct("b.n2", "b.words"), F.struct("n2", "words")
    open_ = bound.join(best, _PASSAGE).where((mine < most) | ((mine == most) & (F.col("b.origin") < F.col("upto"))))
    every = best.unionByName(_of_all_holders(own, met, open_)).groupBy(*_PASSAGE).agg(F.max("b").alias("b"))
    return whole.unionByName(every.select(*_PASSAGE, F.col("b.words").cast("long").alias("words"), F.col("b.origin").alias("origin")))


def replies(parts: DataFrame) -> DataFrame:
    """(conv, turn, r1, r2, reply_to, quoted_words): the message that each quoting message replies to."""
    found = passages(parts)
    quoted = cut(units(found.where("level > 0")).distinct())
    own = units(found.where("level = 0").select("conv", "turn", "body")).select("conv", "turn", "h", "h2")
    row = ["conv", "turn", "r1", "r2"]
    per = origins(own, quoted).groupBy(*row, "origin").agg(F.min("level").alias("level"), F.sum("words").alias("words"))
    best = F.max(F.struct((-F.col("level")).alias("l"), F.col("words"), F.col("origin"))).alias("b")
    return per.groupBy(*row).agg(best).select(*row, F.col("b.origin").alias("reply_to"), F.col("b.words").alias("quoted_words"))


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth): where following `reply_to` ends, and after how many steps."""
    at = cut(links.select("conv", "turn", F.col("reply_to").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        on = at.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("thread2"), F.col("depth").alias("depth2"))
        step = at.join(on, (F.col("conv") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        step = cut(step.select("conv", "turn", F.coalesce("thread2", "thread").alias("thread"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.col("thread2").isNotNull().alias("moved")))
        at, moved = step.drop("moved"), step.where("moved").limit(1).count()
        if not moved:
            return at


def linked(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, reply_to, thread, depth, quote_levels, quoted_words, text): one row a message.

    Ordered by conv, thread and turn these are the conversations, replies after what they answer, without quotes."""
    parts = parsed(messages, conv, turn, role, text)
    links = cut(replies(parts))
    # A turn of several messages goes on by one of them.
    by_turn = links.groupBy("conv", "turn").agg(F.max(F.struct("quoted_words", "reply_to")).alias("b")).select("conv", "turn", F.col("b.reply_to").alias("reply_to"))
    tree = threads(by_turn).select(F.col("conv").alias("c"), F.col("turn").alias("t"), "thread", F.col("depth").alias("above"))
    tree = links.join(tree, (F.col("conv") == F.col("c")) & (F.col("reply_to") == F.col("t")), "left").select(
        "r1", "r2", "reply_to", "quoted_words", F.coalesce("thread", "reply_to").alias("thread"), (F.coalesce("above", F.lit(0)) + 1).alias("depth"))
    own = F.transform(F.filter("lines", lambda x: (x["level"] == 0) & ~x["body"].rlike(ATTRIBUTION)), lambda x: x["body"])
    # Blank lines at either end go.
    full = F.transform(own, lambda x: F.trim(F.translate(x, "\t", " ")) != "")
    first = F.array_position(full, True)
    last = F.size(own) + 1 - F.array_position(F.reverse(full), True)
    said = F.when(first > 0, F.array_join(F.slice(own, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "\n")).otherwise(F.lit(""))
    # A message that quotes nothing keeps every line.
    levels = F.array_max(F.transform("lines", lambda x: x["level"]))
    whole = F.array_join(F.transform("lines", lambda x: x["body"]), "\n")
    rows = parts.select("conv", "turn", "role", "r1", "r2", levels.cast("long").alias("quote_levels"), F.when(levels > 0, said).otherwise(whole).alias("text"))
    rows = rows.join(tree, ["r1", "r2"], "left")
    return rows.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "reply_to", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "quote_levels", F.coalesce("quoted_words", F.lit(0)).cast("long").alias("quoted_words"), F.col("text").alias(text))


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """linked(), sorted into reply-ordered conversations within each output file."""
    out = linked(messages, conv, turn, role, text)
    return out.repartitionByRange(F.col(conv), F.col("thread"), F.col(turn)).sortWithinPartitions(conv, "thread", turn)
