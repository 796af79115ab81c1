"""Secret scan: candidates by their looks, false positives removed by a random forest.

The forest reads a candidate's length, character transitions, share covered by dictionary words, path
looks and neighbouring words. It is trained from labelled findings. Where none are given, secrets and
look-alikes of random making are planted between the words of a half of the documents, so labels are
known from the planting and don't follow from features; the forest alone decides. The dictionary is the corpus'
own words by document frequency.
"""

from __future__ import annotations

import bisect
import math
import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectio.llm.common import cut, free_name, map_arrow

#: At most so many labelled findings of each class train the forest.
TRAINING_ROWS = 5_000
#: Documents whose passages carry planted findings, characters of a passage, and the seed of what is planted.
CARRIERS, PASSAGE, SEED = 1_000, 240, 11
#: Size of the dictionary: the words of most documents, of at least two.
DICTIONARY = 20_000
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z0-9_+/=.@-]*[0-9])[A-Za-z0-9_+/=-][A-Za-z0-9_+/=.@-]{14,}(?![A-Za-z0-9_+/=.@-])")
#: An assignment sign inside a run; '=' at the end of a value is padding.
ASSIGNMENT = re.compile(r"=(?=[^=])")
#: A name with what is assigned to it: quoted, blanks included, or up to a blank. Each run of name characters is tried once.
ASSIGNED = re.compile(r"""(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z0-9_.-]++)["'`]?[^\S\n]*+(?:[=:]|=>|:=)[^\S\n]*+(?:"(?P<a>[^"\n]{6,})"|'(?P<b>[^'\n]{6,})'|`(?P<c>[^`\n]{6,})`|(?P<d>[^\s"'`,;=:][^\s"'`,;]{5,}))""")
#: The body of a private key.
PRIVATE = re.compile(r"-----BEGIN [A-Z ]*+(?<=PRIVATE KEY)-----\s*+(?P<value>[^-]++)(?=-----END )")
TELLING = re.compile(r"(?i:api|access|auth|bearer|client|credential|key|pass|private|pwd|secret|token)")
#: Names between other characters than letters, or as parts of names like clientSecret.
NAMES = re.compile(r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:api|access|auth|bearer|client|credential|key|passphrase|passwd|password|private|pwd|secret|token)(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))")
KNOWN = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Whole words of prose, for the dictionary: no parts of runs with digits or signs.
PROSE = r"(?<![a-z0-9_+/=.@-])[a-z]{3,20}(?![a-z0-9_+/=@-])"
FIELDS = "doc_id bigint, text_key bigint, start int, length int, candidate string, before string, features array<double>"


def kind_of(c: str) -> str:
    return "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "s"


def coverage(found: str, words: frozenset[str]) -> float:
    """The share of a candidate's characters in dictionary words: whole parts, or longest words from the left."""
    total = 0
    for part in PARTS.findall(found):
        part, k = part.lower(), 0
        while k + 3 <= len(part):
            n = next((n for n in range(min(20, len(part) - k), 2, -1) if part[k : k + n] in words), 0)
            total, k = total + n, k + max(1, n)
    return total / len(found)


def features(found: str, before: str, after: str, words: frozenset[str]) -> list[float]:
    n = len(found)
    kinds = [kind_of(c) for c in found]
    moves = [a + b for a, b in zip(kinds, kinds[1:], strict=False)]
    share = lambda m: sum(x == m for x in moves) / max(1, len(moves))
    counts = [found.count(c) / n for c in set(found)]
    near = re.findall(r"[a-z]+", before[-40:].lower())
    return [
        float(n),
        -sum(p * math.log2(p) for p in counts),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1),
        *(share(m) for m in ("dd", "dl", "ld", "ll", "lu", "ul", "uu")),
        *(kinds.count(k) / n for k in "dlus"),
        coverage(found, words),
        found.count("/") / n,
        float("@" in found),
        float(found.count(".")),
        float(found.count(" ")),
        float(bool(re.search(r"\.\w{1,4}$", found))),
        float(bool(re.fullmatch(r"[0-9a-fA-F-]+", found))),
        float(bool(KNOWN.fullmatch(found))),
        float(bool(re.search(r"[(){}<>\[\]$]", found))),
        float(bool(NAMES.search(before[-40:]))),
        float(bool(near) and bool(NAMES.search(near[-1]))),
        float(sum(w in words for w in near[-3:])),
        float(bool(re.search(r"""[=:]\s*["'`]?$""", before))),
        float(bool(re.search(r"""["'`]$""", before)) and bool(re.match(r"""["'`]""", after))),
        float(before.rstrip().endswith("PRIVATE KEY-----")),
    ]


def planted_secret(rng: random.Random, words: list[str]) -> tuple[str, str, str]:
    """(before, value, after) of a secret: keys of known services, random values of telling names, passwords and private keys."""
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    alnum = string.ascii_letters + string.digits
    form = rng.randrange(-1, 10)
    if form < 1:
        return _planted_known(rng, pick, alnum)
    if form == 1:
        return "-----BEGIN RSA PRIVATE KEY-----\n", "\n".join(pick(alnum + "+/", 64) for _ in range(rng.randrange(2, 12))) + "\n", "-----END RSA PRIVATE KEY-----"
    value = pick("0123456789abcdef", rng.choice((32, 40, 48, 64))) if form < 5 else pick(alnum + rng.choice(("", "+/", "-_", "+/-_")), rng.randrange(18, 60)) + rng.choice(("", "", "=", "=="))
    if form == 8:
        value = "".join(rng.choice(words).capitalize() if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randrange(1, 3))) + pick(string.digits, rng.randrange(1, 5)) + pick("!#$%", rng.randrange(2))
    if form == 9:
        value = rng.choice("- _").join(rng.choice((w, w.capitalize())) for w in rng.choices(words, k=rng.randrange(3, 6)))
    name = rng.choice(("password", "passphrase", "db_passwd", "PWD", "DB_PASSWORD") if form > 7 else ("token", "api_key", "API_KEY", "client_secret", "clientSecret", "access_token", "AWS_SECRET_ACCESS_KEY", "aws_secret_access_key", "auth_token", "AUTH_TOKEN_2", "private_key", "secret", "apiKey"))
    before, after = rng.choice(((f"{name}=", "\n"), (f'{name} = "', '"'), (f"{name}: '", "'"), (f'"{name}": "', '"'), (f"export {name}=", "\n"), (f"{name}: ", "\n")))
    if " " in value:
        before, after = f'{name} = "', '"'
    return before, value, after


def _planted_known(rng: random.Random, pick, alnum: str) -> tuple[str, str, str]:
    value = rng.choice((rng.choice(("AKIA", "ASIA")) + pick(string.ascii_uppercase + string.digits, 16), f"gh{rng.choice('pousr')}_" + pick(alnum, 36), f"xox{rng.choice('abprs')}-{pick(string.digits, rng.randrange(9, 13))}-{pick(rng.choice((alnum, '0123456789abcdef', string.ascii_lowercase)), rng.randrange(6, 26))}"))
    before, after = rng.choice((("", "\n"), ("", " "), ("key ", "."), ('= "', '"'), ("at ", ","), ("token: ", "\n")))
    return before, value, after


def planted_lookalike(rng: random.Random, words: list[str]) -> tuple[str, str, str]:
    """(before, value, after) of what looks like a secret and is none: digests, ids, paths, names, dates, placeholders, code and prose."""
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    some = lambda low, high: rng.choices(words, k=rng.randrange(low, high))
    hexa, digits = "0123456789abcdef", string.digits
    form = rng.randrange(12)
    name = rng.choice(("token", "api_key", "password", "secret", "client_secret", "access_token", "key", "DB_PASSWORD", "passphrase"))
    if form == 0:
        return rng.choice(("commit ", "sha256:", "checksum: ", "md5 = ", "revision ", 'etag: "', "tree ", "digest ")), pick(hexa, rng.choice((32, 40, 64))), rng.choice((" ", "\n", ".", '"'))
    if form == 1:
        return rng.choice(("id ", "request ", 'uuid = "', "", "session: ")), "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), rng.choice((" ", '"', "\n"))
    if form == 2:
        return rng.choice(("", "in ", "from ", 'path = "')), "/" + "/".join(some(2, 6)) + f"{pick(digits, 2)}.{rng.choice(('py', 'txt', 'html', 'so', 'json'))}", " "
    if form == 3:
        return rng.choice(("", "see ", "the ", 'class="')), rng.choice("-_").join([*some(2, 5), pick(digits, rng.randrange(1, 5))]), rng.choice((" ", ".", '"', ","))
    if form == 4:
        return rng.choice(("", "no. ", "order ", "call ", "card ")), pick(digits + rng.choice(("", "-", "-")), rng.randrange(15, 24)).strip("-") + "0", " "
    if form == 5:
        return rng.choice(("on ", "at ", "")), f"20{pick(digits, 2)}-0{rng.randrange(1, 10)}-1{pick(digits, 1)}T0{pick(digits, 1)}:00:00.{pick(digits, 6)}", " "
    if form == 6:
        value = rng.choice((f"your-{name}-here", f"your_{name}", f"<{name}>", "${" + name.upper() + "}", "{{ " + name + " }}", "xxxxxxxxxxxx", "************", f"example-{name}", "not-set", "REPLACE_ME"))
        return f'{name} = "', value, '"'
    if form == 7:
        value = rng.choice((f"os.environ[{name}]", f"get_{rng.choice(words)}()", f"config.{rng.choice(words)}.{name}", f"self._{rng.choice(words)}", f"process.env.{name.upper()}", f"request.{rng.choice(words)}"))
        return f"{name}{rng.choice((' = ', '=', ': '))}", value, "\n"
    if form == 8:
        return f"the {name}: ", rng.choice([w for w in words if len(w) > 5] or ["nothing"]), " " + " ".join(some(2, 5))
    if form == 9:
        return f'{rng.choice(("token_type", "key_name", "access_level", "client_name", "auth_mode"))} = "', "_".join(some(2, 4)), '"'
    if form == 10:
        return rng.choice(("", "see ", 'href="')), f"www.{rng.choice(words)}.org/{rng.choice(words)}/{rng.choice(words)}-{pick(digits, rng.randrange(3, 8))}", " "
    return rng.choice(("", "mail ", "write to ")), f"{rng.choice(words)}.{rng.choice(words)}{pick(digits, 2)}@{rng.choice(words)}.example.org", " "


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """(start, candidate); a run with an assignment gives its sides that are candidates by themselves, if there are any.

    Values of telling names and bodies of private keys are candidates too, however short, plain or long they are.
    A run that such a value begins in gives way to it. Of others that overlap, the one that starts first stays, and of those the longest.
    """
    end, values = 0, sorted(_assigned(text))
    starts = [start for start, _ in values]
    inside = lambda start, found: bisect.bisect_right(starts, start) < bisect.bisect_left(starts, start + len(found))
    runs = [x for x in _runs(text) if not inside(*x)]
    for start, found in sorted([*runs, *values], key=lambda x: (x[0], -len(x[1]))):
        if start >= end:
            yield start, found
            end = start + len(found)


def _assigned(text: str) -> Iterator[tuple[int, str]]:
    for m in ASSIGNED.finditer(text):
        if TELLING.search(m["name"]):
            kind = m.lastgroup
            value = m[kind].rstrip(".)]}>") if kind == "d" and not m[kind].startswith(("$", "<", "{", "[", "(")) else m[kind]
            if len(value) >= 6:
                yield m.start(kind), value
    if "PRIVATE KEY-----" in text:
        yield from ((m.start("value"), m["value"]) for m in PRIVATE.finditer(text))


def _runs(text: str) -> Iterator[tuple[int, str]]:
    for m in CANDIDATE.finditer(text):
        signs = [x.start() for x in ASSIGNMENT.finditer(m[0])]
        bounds = zip([0, *(x + 1 for x in signs)], [*signs, len(m[0])], strict=True)
        sides = [(m.start() + a, m[0][a:b]) for a, b in bounds if CANDIDATE.fullmatch(m[0][a:b])]
        yield from sides or [(m.start(), m[0])]


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> frozenset[str]:
    """The ``size`` words that most documents have, of those that two or more have; ties by the word."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(PROSE), F.lit(0)))
    counts = docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("df")).filter("df > 1")
    # Picked by a task, not by the driver, which would get as many words of each partition.
    return frozenset(r["word"] for r in cut(counts.orderBy(F.desc("df"), "word").limit(size)).select("word").collect())


def findings(docs: DataFrame, words: frozenset[str]) -> DataFrame:
    """Candidates of all documents with their features.

    Null and empty texts have none; rows that share a doc_id, or have none, keep apart by text_key.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for start, found in candidates(text):
                before, after = text[max(0, start - 60) : start], text[start + len(found) : start + len(found) + 20]
                rows.append((doc_id, key, start, len(found), found, before, features(found, before, after, words)))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text_key", "start", "length", "candidate", "before", "features"])

    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts.filter(F.col("text").rlike("[0-9=:]|-----BEGIN ")), run, FIELDS)


LABELLED = "candidate string, start int, label int, features array<double>"


def _labelled(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["candidate", "start", "label", "features"])


def planted(docs: DataFrame, words: frozenset[str], half: int = 0, rows: int = TRAINING_ROWS, seed: int = SEED) -> DataFrame:
    """Labelled findings (candidate, start, label, features): secrets and look-alikes planted in passages of a half of the documents.

    At most CARRIERS documents, those of the least hashes, give a passage each from a place by its hash; a passage
    takes as many of either class as make up ``rows``. The other ``half`` serves to measure.
    """
    own = docs.filter(F.length(F.col("text").cast("string")) > 0).filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half)
    text = F.col("text").cast("string")
    order = F.xxhash64("doc_id", text)
    at = F.pmod(order, F.length(text)).cast("int") + 1
    passages = cut(own.select(order.alias("order"), text.substr(at, F.lit(PASSAGE)).alias("passage")).orderBy("order", "passage").limit(CARRIERS))
    n = passages.count()
    if not n:
        passages, n = docs.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("order"), F.lit("").alias("passage")), 1
    known = sorted(words) or ["value", "example"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for order, passage, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rng = random.Random(f"{seed}/{half}/{order}/{k}")
            for label, make in enumerate((planted_lookalike, planted_secret)):
                before, value, after = make(rng, known)
                gaps = [i for i, c in enumerate(passage) if c.isspace()] or [len(passage)]
                place = rng.choice(gaps)
                left = passage[:place] + rng.choice((" ", "\n")) + before
                whole = left + value + after + passage[place:]
                for start, found in candidates(whole):
                    if start < len(left) + len(value) and start + len(found) > len(left):
                        out.append((found, start, label, features(found, whole[max(0, start - 60) : start], whole[start + len(found) : start + len(found) + 20], words)))
        return _labelled(out)

    dealt = passages.select("order", "passage", F.explode(F.sequence(F.lit(1), F.lit(-(-rows // n)))).alias("k"))
    return map_arrow(dealt, run, LABELLED)


def text_key() -> Column:
    """What tells rows of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def train(labelled: DataFrame, trees: int = 40, rows: int = TRAINING_ROWS) -> RandomForestClassificationModel | None:
    """A forest from at most ``rows`` labelled findings of each class, or None if there is only one class."""
    picked = None
    for label in (0, 1):
        own = labelled.filter(F.col("label") == label).select("label", "features").orderBy(F.xxhash64("candidate"), "start", F.xxhash64("features")).limit(rows)
        picked = own if picked is None else picked.unionByName(own)
    picked = cut(picked.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("vector")))
    if picked.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=10, featureSubsetStrategy="onethird", seed=7).fit(picked)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """Findings with the forest's score and whether they are kept: doc_id, text_key, start, length, candidate, score, secret.

    ``labelled`` has candidate, before, after, label and trains the forest. Without it, planted() does, from
    documents whose hash is even. If only one class is labelled, scores are 0. Null and empty texts have no
    findings; repeated rows have theirs each. Start counts code points. Columns beyond doc_id and text are not read.
    Texts are read whole and candidates may be of any length; an empty table has no findings. The training
    sample is drawn by hashes of candidate, place and features, so ties are equal rows.
    """
    words = dictionary(docs)
    found = cut(findings(docs, words))
    if labelled is None:
        known = planted(docs, words)
    else:

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*(x.to_pylist() for x in batch.columns), strict=True)
            return _labelled([(c, 0, int(y), features(c, b or "", a or "", words)) for c, b, a, y in rows if c])

        known = map_arrow(labelled.select("candidate", "before", "after", F.col("label").cast("int")), run, LABELLED)
    scored = _scored(train(known), found)
    return scored.select("doc_id", "text_key", "start", "length", "candidate", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("secret"))


def _scored(model: RandomForestClassificationModel | None, found: DataFrame) -> DataFrame:
    if model is None:
        return found.withColumn("score", F.lit(0.0))
    return model.transform(found.withColumn("vector", array_to_vector("features"))).withColumn("score", F.element_at(vector_to_array("probability"), 2))


def measure(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(precision, recall, findings) of the forest of scan() on what is planted, by another seed, in the other half of the documents."""
    words = dictionary(docs)
    held = _scored(train(planted(docs, words)), planted(docs, words, half=1, seed=SEED + 1))
    said, is_one = F.col("score") >= threshold, F.col("label") == 1
    hit = F.count_if(said & is_one)
    return held.agg(F.round(hit / F.count_if(said), 4).alias("precision"), F.round(hit / F.count_if(is_one), 4).alias("recall"), F.count("*").alias("findings"))


def redact(docs: DataFrame, found: DataFrame, mask: str = "[secret]") -> DataFrame:
    """Documents with the secrets of ``found`` masked; other columns stay.

    Findings go to the rows that have their doc_id, or none, and their text; null texts stay null.
    """
    name, key, own = free_name(docs, "_spans"), free_name(docs, "_doc"), free_name(docs, "_key")
    spans = found.filter("secret").groupBy(F.col("doc_id").alias(key), F.col("text_key").alias(own)).agg(F.sort_array(F.collect_set(F.struct("start", "length")), asc=False).alias(name))
    put = F.aggregate(name, F.col("text"), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(mask), F.substring(t, s["start"] + s["length"] + 1, F.length(t))))
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(key)) & (text_key() == F.col(own)), "left")
    return joined.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(put)).select(docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """For each row of documents: n_candidates, n_secrets, top_score and the secrets' places as start+length, joined.

    Null and empty texts have none and a top_score of 0; repeated rows get equal results; rows that
    share a doc_id, or have none, get their own; an empty table gives an empty result.
    """
    found = scan(docs)
    place = F.struct("start", "length")
    per = found.groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(
        F.size(F.collect_set(place)).cast("bigint").alias("n_candidates"),
        F.size(F.collect_set(F.when(F.col("secret"), place))).cast("bigint").alias("n_secrets"),
        F.max("score").alias("top_score"),
        F.sort_array(F.collect_set(F.when(F.col("secret"), F.struct("start", "length")))).alias("places"),
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key().alias("text_key"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    places = F.transform(F.coalesce("places", F.array().cast("array<struct<start:int,length:int>>")), lambda p: F.concat_ws("+", p["start"], p["length"]))
    return out.select("doc_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_secrets", F.lit(0)).alias("n_secrets"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.array_join(places, ",").alias("places"))
