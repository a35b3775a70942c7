"""Operator 2: secret scan with a random forest that removes false positives.

1. One pattern finds candidates in whole texts: keys of known form, values assigned to a name like password
   or token, long strings with digits. Splitting at the pattern gives the text around each candidate.
2. Each candidate gets the features of FEATURES: length, character transitions, dictionary coverage,
   make-up, the path of the document and the neighbouring words.
3. A random forest, trained from labelled findings, is compiled into one SQL expression over the features;
   its share of votes is the score. Scoring is part of the projection that reads the text: no shuffle, no
   user function. Training uses at most MAX_LABELLED findings, whatever the corpus.

Labelled findings are rows (before, match, after, path, label); labelled_findings() makes a bundled set by
rule, of known kinds of secrets and of look-alikes, for use where a team has not yet labelled its own.

Defined results: null or empty texts have no findings; long texts are read whole; a null path is an empty
one; repeated rows have the same findings; an empty table gives no rows; with redact() all columns stay,
whatever their names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a secret is assigned to (fixed values).
NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential"

#: Candidate forms (fixed values): name, pattern.
FORMS = (
    ("assigned", rf"(?:{NAMES})\w{{0,16}}[\"']?\s{{0,4}}(?:=>|:=|[:=])\s{{0,4}}[\"']?[^\s\"']{{6,}}+"),
    ("cloud_key", r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*"),
    ("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ ){0,3}PRIVATE KEY-----)?"),
    ("long", r"(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+(?![\"']?(?:[:=][\"']?[A-Za-z0-9]|\s{1,4}[:=]|:\s))(?:={1,2})?"),
)
#: A name may stand inside an identifier, after a sign or digit or where a capital begins a part of it. No form can begin again inside what it
#: has read through in vain, so that the scan is linear in the text.
PATTERN = (
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:" + FORMS[0][1] + r")|(?<![A-Za-z0-9])(?:" + "|".join(p for _, p in FORMS[1:3]) + r"|" + FORMS[5][1]
    + r")|(?<![A-Za-z0-9_-])(?:" + "|".join(p for _, p in FORMS[3:5]) + r")|(?<![A-Za-z0-9+/_-])" + FORMS[6][1]
)

#: Words that make up look-alikes and code, for dictionary coverage (fixed values).
DICTIONARY = (
    "account admin access auth authentication bearer change changeme client cloud code config connection "
    "credential data database default demo dummy email environment example fake field file form global host http "
    "https insert internal international local localhost login master message mock model module name null object "
    "option page param pass passphrase password path placeholder please private process production public reader "
    "request required response sample secret server service session setting stage string super system table temp test "
    "token type update user username validate value variable version web welcome word write xxxx your abcd 1234 qwerty letmein"
).split()
NEAR_KEYS = r"(?i)pass|pwd|secret|token|key|credential|auth|login|bearer"
NEAR_LOOKALIKES = r"(?i)example|sample|dummy|placeholder|checksum|sha-?1|sha-?256|md5|commit|digest|hash|uuid|guid|revision|etag|fixture|changeme|your"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|mocks?|fixtures?|examples?|samples?|docs?|readme)([/_.-]|$)"

FEATURES = ("length", "transitions", "coverage", "distinct", "digits", "uppers", "hex", "dashes", "known", "assigned", "key_near", "lookalike_near", "lookalike_before", "test_path")
TREES, DEPTH, SEED = 24, 6, 7
#: Kinds of secrets among the bundled findings.
SECRETS = 8
#: Lengths are summed up in blocks of this many findings.
BLOCK = 256
#: The most labelled findings the forest is trained on, least hash first.
MAX_LABELLED = 20_000
#: Characters on either side that count as neighbouring words.
AROUND = 48
JUST_BEFORE = 16
REDACTED = "<SECRET>"


def value_of(match: Column) -> Column:
    """The secret itself: an assigned value without its name and quotes, else the whole match."""
    return F.regexp_replace(match, rf"^(?i:(?:{NAMES})\w{{0,16}}[\"']?\s{{0,4}}(?:=>|:=|[:=])\s{{0,4}}[\"']?)", "")


def _share(of: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(of, pattern, "")) / F.greatest(F.length(of), F.lit(1))


def features(before: Column, match: Column, after: Column, path: Column) -> list[Column]:
    value = value_of(match)
    near = F.concat(F.right(before, F.lit(AROUND)), F.lit(" "), match, F.lit(" "), F.left(after, F.lit(AROUND)))
    runs = F.size(F.regexp_extract_all(value, F.lit(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)))
    known = "|".join(p for n, p in FORMS[1:6])
    return [
        F.length(value).cast("double"),
        (runs - 1) / F.greatest(F.length(value), F.lit(1)),
        1 - _share(F.lower(value), "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))),
        F.size(F.array_distinct(F.split(value, ""))) / F.greatest(F.length(value), F.lit(1)),
        _share(value, r"[^0-9]"),
        _share(value, r"[^A-Z]"),
        value.rlike(r"^[0-9a-fA-F]+\z").cast("double"),
        _share(value, r"[^-]"),
        value.rlike(f"^(?:{known})").cast("double"),
        (F.length(match) > F.length(value)).cast("double"),
        near.rlike(NEAR_KEYS).cast("double"),
        near.rlike(NEAR_LOOKALIKES).cast("double"),
        F.right(before, F.lit(JUST_BEFORE)).rlike(NEAR_LOOKALIKES).cast("double"),
        F.coalesce(path, F.lit("")).rlike(TEST_PATH).cast("double"),
    ]


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """(before, match, after, path, label): `n` findings made by rule, of SECRETS kinds of secrets and as many kinds of look-alikes.

    The words around are drawn without regard to the label but for the kinds that words tell apart."""
    def pick(values: str, salt: int) -> str:
        return f"element_at(split('{values}', '[|]'), cast(pmod(xxhash64(id, {salt}), {values.count('|') + 1}) as int) + 1)"

    def code(salt: int, length: str) -> str:
        return f"left(translate(base64(unhex(concat(sha2(concat(id, '-{salt}'), 512), sha2(concat(id, '+{salt}'), 512)))), '+/=\n\r', 'xyz'), {length})"

    hexes = "sha2(concat('h', id), 256)"
    digits = "cast(abs(xxhash64(id, 40)) as string)"
    plain = pick("the|of and|en la|und der|et les|in this|value is|x =|se on|thing", 1)
    calm = pick("commit|checksum|sha256|revision|etag|digest of|md5 hash|uuid", 2)
    words = pick("changeme|your_password_here|example-password|placeholder|test1234|dummy_value|password123|sample_token_value|<insert-secret>|default_user_password", 3)
    some = pick("example|your-token-here|sample-token|placeholder-value|insert-token-here|dummy-token-value", 28)
    kinds = [
        f"concat('AKIA', upper({code(4, '16')}))",
        f"concat('password', {pick('=|: |=\"', 5)}, left({hexes}, 12 + cast(pmod(id, 20) as int)))",
        f"concat({pick('token|secret|api_key|access_key|auth_token|api-key|SECRET_KEY|Token', 6)}, {pick(' = \"|=|: |=\"', 7)}, left({hexes}, 24 + cast(pmod(id, 40) as int)))",
        f"concat({pick('ghp_|gho_|ghs_', 8)}, {code(9, '36')})",
        f"concat({pick('secret|password|passwd|pwd|client_secret|Password', 10)}, {pick('=|: |=\"', 11)}, {code(12, '10 + cast(pmod(id, 24) as int)')})",
        f"concat({pick('xoxb|xoxp|xoxa|xoxs', 29)}, '-', left({digits}, 12), '-', {code(30, '8 + cast(pmod(id, 20) as int)')})",
        f"concat('eyJ', {code(31, '20 + cast(pmod(id, 16) as int)')}, '.eyJ', {code(32, '30 + cast(pmod(id, 40) as int)')}, '.', {code(33, '43')})",
        f"concat('-----BEGIN ', {pick('RSA |EC ||OPENSSH ', 34)}, 'PRIVATE KEY-----\n', {code(35, '64')}, '\n', {code(36, '64')}, '\n')",
        f"left({hexes}, 32 + 8 * cast(pmod(id, 5) as int))",
        f"concat({pick('password|token|secret|passwd|api_key|Password', 13)}, {pick('=|: |=\"', 14)}, {words})",
        f"concat_ws('-', left({hexes}, 8), substr({hexes}, 9, 4), substr({hexes}, 13, 4), substr({hexes}, 17, 4), substr({hexes}, 21, 12))",
        f"concat('AKIA', upper({code(15, '9')}), 'EXAMPLE')",
        f"concat({pick('internal|global|default|service|session', 16)}, '_', {pick('connection|authentication|environment|configuration', 17)}, '_', {pick('string|variable|settings|version', 18)}, '_', cast(pmod(id, 99) as string))",
        f"concat({pick('xoxb|xoxp|xoxa', 37)}, '-', {some})",
        f"concat('eyJ', replace({some}, '-', ''), '.', replace({pick('payload-goes-here|examplepayload|your-payload', 38)}, '-', ''), '.', {pick('signature|example|xxxx', 39)})",
        f"concat('-----BEGIN PRIVATE KEY-----\n', {pick('your private key here|<insert key>|example|placeholder text only', 41)}, '\n')",
    ]
    match = "case k " + " ".join(f"when {i} then {x}" for i, x in enumerate(kinds)) + " end"
    inside = f"case when k in (1, 2, 4, 9) then {pick('|||DB_|STRIPE_|my_|APP-', 27)} else '' end"
    before = f"concat({pick('on the|ser|y la|for all|.|)', 19)}, ' ', case when k in ({SECRETS}, {SECRETS + 2}) then {calm} else {plain} end, ' ', {inside})"
    # Words of look-alikes also stand near one secret in five, and words of secrets near one look-alike in five.
    other = f"case when k < {SECRETS} then {pick('commit|checksum|sha256|example|digest|uuid', 25)} else {pick('token|password|login|secret|key', 26)} end"
    after = f"concat(' ', {pick('and the|que|of it|der|.|next', 23)}, ' ', case when pmod(xxhash64(id, 24), 5) = 0 then {other} else '' end)"
    path = f"""case when k in (9, 11, 13) and pmod(xxhash64(id, 20), 3) > 0 then {pick('tests/fixtures/a.json|docs/readme.md|examples/run.py', 21)}
        else {pick('src0|src12|src/app.py|config/prod.yml|lib/main.js|deploy/env.sh', 22)} end"""
    rows = spark.range(0, n, 1, 1).selectExpr("id", f"cast(pmod(id, {2 * SECRETS}) as int) as k")
    rows = rows.selectExpr("id", "k", f"{before} as before", f"{match} as match", f"{after} as after", f"{path} as path")
    return rows.selectExpr("before", "match", "after", "path", f"case when k < {SECRETS} then 1.0D else 0.0D end as label")


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, max_labelled: int = MAX_LABELLED) -> RandomForestClassificationModel:
    """A forest from at most `max_labelled` findings, in an order of their own so that reruns agree."""
    columns = [c.alias(n) for c, n in zip(features(*(F.col(c) for c in ("before", "match", "after", "path"))), FEATURES, strict=True)]
    rows = labelled.dropna(subset=["before", "match", "after", "label"])
    order = F.xxhash64("before", "match", "after", "path")
    rows = rows.orderBy(order, "match").limit(max_labelled).select(*columns, F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="onethird").fit(rows)


def _tree(lines: list[str], value) -> Column:
    """The tree printed in `lines`, from the first on, as an expression; uses them up."""
    line = lines.pop(0)
    if m := re.match(r"Predict: (\S+)", line):
        return F.lit(float(m[1]))
    index, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = _tree(lines, value)
    lines.pop(0)
    return F.when(value(FEATURES[int(index)]) <= float(threshold), low).otherwise(_tree(lines, value))


def forest_score(model: RandomForestClassificationModel, value) -> Column:
    """Share of the trees that vote for a secret; value(name) gives the column of a feature."""
    votes = [_tree([x.strip() for x in t.toDebugString.split("\n")[1:] if x.strip()], value) for t in model.trees]
    return reduce(lambda a, b: a + b, votes) / len(votes)


def _found(docs: DataFrame, text: str, path: str, model, only: bool = False) -> DataFrame:
    """`docs` with _found: array of (match, score), in order of position, and _parts around; `only` those with a finding."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0))
    # inline() of one struct: what follows, a filter too, does not scan the text again.
    at = docs.select("*", F.inline(F.array(F.struct(found.alias("_found")))))
    at = at.where(F.size("_found") > 0) if only else at
    # Only a text with candidates is split.
    at = at.withColumn("_parts", F.when(F.size("_found") > 0, F.split(F.col(text), PATTERN, -1)))
    source = F.col(path).cast("string")

    def described(match: Column, i: Column) -> Column:
        got = features(F.get("_parts", i), match, F.get("_parts", i + 1), source)
        return F.struct(match.alias("match"), *[c.alias(n) for c, n in zip(got, FEATURES, strict=True)])

    at = at.withColumn("_found", F.when(F.size("_found") > 0, F.transform("_found", described)))
    return at.withColumn("_found", F.transform("_found", lambda s: F.struct(s["match"].alias("match"), forest_score(model, lambda n: s[n]).alias("score"))))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", model=None, least: float = 0.5) -> DataFrame:
    """(key, position, form, secret, score, is_secret): a row for each candidate; position counts code points from 0."""
    model = model or train(labelled_findings(docs.sparkSession))
    rows = _found(docs.select(F.col(key), F.col(text).alias("text"), F.col(path).alias("path")), "text", "path", model, only=True)
    # Where each finding begins: sums of whole blocks before it, then of its block; only then are findings dealt out.
    rows = rows.withColumn("_steps", F.expr("zip_with(slice(_parts, 1, size(_found)), _found, (a, b) -> cast(length(a) + length(b.match) as bigint))"))
    rows = rows.withColumn("_sums", F.expr(f"transform(sequence(0, (size(_steps) - 1) div {BLOCK}), j -> aggregate(slice(_steps, cast(j * {BLOCK} + 1 as int), {BLOCK}), 0L, (a, x) -> a + x))"))
    rows = rows.withColumn("_before", F.expr("transform(sequence(0, size(_sums) - 1), j -> aggregate(slice(_sums, 1, j), 0L, (a, x) -> a + x))"))
    # inline() of one struct: sums are made once for a text, not again for each finding.
    rows = rows.select(key, F.inline(F.array(F.struct("_found", F.transform("_parts", lambda x: F.length(x)).alias("_sizes"), "_steps", "_before"))))
    at = (f"get(_before, i div {BLOCK}) + aggregate(slice(_steps, cast((i div {BLOCK}) * {BLOCK} + 1 as int), i % {BLOCK}), 0L, (a, x) -> a + x) + get(_sizes, i)")
    rows = rows.select(key, F.explode(F.expr(f"transform(_found, (x, i) -> struct(x.match as match, x.score as score, {at} as at))")).alias("f"))
    value = value_of(F.col("f.match"))
    form = reduce(lambda rest, f: F.when(value.rlike(f"^(?:{f[1]})"), f[0]).otherwise(rest), reversed(FORMS[1:6]), F.when(F.length("f.match") > F.length(value), "assigned").otherwise("long"))
    at = (F.col("f.at") + F.length("f.match") - F.length(value)).cast("long")
    return rows.select(key, at.alias("position"), form.alias("form"), value.alias("secret"), F.round("f.score", 6).alias("score"), (F.col("f.score") >= least).alias("is_secret"))


def redact(docs: DataFrame, text: str = "text", path: str = "source", model=None, least: float = 0.5, mark: str = REDACTED) -> DataFrame:
    """`docs` with every secret in the text replaced by `mark`; look-alikes, other texts and columns stay."""
    model = model or train(labelled_findings(docs.sparkSession))
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), F.col(path).alias("_path"))
    at = _found(packed, "_text", "_path", model)

    def shown(f: Column) -> Column:
        value = value_of(f["match"])
        name = F.left(f["match"], F.length(f["match"]) - F.length(value))
        return F.when(f["score"] >= least, F.concat(name, F.lit(mark))).otherwise(f["match"])

    pairs = F.zip_with("_parts", F.transform("_found", shown), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    clean = F.when(F.size("_found") > 0, F.array_join(pairs, "")).otherwise(F.col("_text"))
    return at.select(F.col("_row").alias("_row"), clean.alias("_clean")).select(
        *[F.col("_clean").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
