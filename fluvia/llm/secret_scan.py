"""Secret scans with DataFrame functions only.

Candidates are runs of key characters, cut out of each text together with what stands around them.
A random forest over candidate length, character transitions, dictionary coverage, path and
neighbouring words removes false positives. The forest is trained on labelled findings, whose
features are computed by the same expressions, and is applied as nested CASE expressions, so that
scanning runs inside the JVM. Only findings are shuffled, to sum up their positions.
"""

from __future__ import annotations

import base64
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How names of secrets end where a value follows; there a run of eight characters is enough.
ASSIGNED = r"(?i:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential)[\"']?[ ]?[=:][ ]?[\"'`]?"
#: A candidate: a whole run of at least 16 key characters, or of 8 where a secret is assigned; '=' belongs to
#: it as trailing padding only, so NAME=value is two runs. Runs are tried at their start only, so matching is
#: linear. The forest decides on all of them. Then the characters of context on either side.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?:[A-Za-z0-9+/_\-]{16,}+|(?<=" + ASSIGNED + r")[A-Za-z0-9+/_\-]{8,15}+(?![A-Za-z0-9+/_\-]))(?:={1,2}(?![A-Za-z0-9+/_=\-]))?"
BEFORE, AFTER = 48, 24
#: Trees of the forest, their depth, the least findings in a leaf, share of trees that must agree.
TREES, DEPTH, LEAF, SEED, THRESHOLD = 11, 5, 4, 5, 0.5
#: Findings of either label that the built-in training set has, and that are learnt from a table at most.
FINDINGS, LABELLED = 700, 5000

#: Words whose letters count as covered by a dictionary.
DICTIONARY = (
    "account address android apache application archive array assets backup base beta build button cache checkout class client "
    "cloud code common component config connection container content control core count create data date default demo device "
    "directory document download dummy element engine error event example external factory file filter format function group "
    "handler header home html http image import index info input interface internal item java lang layout library license link "
    "list load local location login main manager message method model module name network node number object option order "
    "package page param parser password path photo placeholder plugin point process product profile project property python "
    "query random readme record release remote report request resource response result sample schema script search section "
    "server service session setting shared simple source spark standard start static status storage string style system table "
    "target template test text theme thread time title token type unit update upload user util value version video view web "
    "widget window work"
).split()
#: Words near a candidate that speak for and against a secret.
SECRET_CUES = "token|secret|passw|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|signing"
OTHER_CUES = "commit|sha-?1|sha-?256|md5|checksum|digest|hash|revision|uuid|guid|etag|integrity|example|sample|build|version|card|order|phone"
#: How keys of well-known issuers begin.
ISSUED = r"^(AKIA|ASIA|ghp_|gho_|ghs_|ghu_|glpat-|sk_live_|rk_live_|sk-|xox[abpr]-|AIza|ya29|eyJ|npm_|pypi-|SG)"
COMMON_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|ou"

FEATURES = ("size", "digits", "uppers", "marks", "classes", "changes", "variety", "pairs", "words", "hexadecimal", "issued", "slashes", "in_path", "extension", "repeats", "assigned", "quoted", "secret_cue", "other_cue")


def features(candidate: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numeric features of a candidate and its context, by name."""
    n = F.length(candidate)
    share = lambda pattern: F.length(F.regexp_replace(candidate, f"[^{pattern}]", "")) / n
    letters = string.ascii_lowercase + string.ascii_uppercase + string.digits
    kinds = F.translate(candidate, letters, "a" * 26 + "A" * 26 + "0" * 10)
    low = F.lower(candidate)
    covered = F.length(F.regexp_replace(low, f"({'|'.join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))})", ""))
    flag = lambda c: c.cast("int")
    made = {
        "size": n,
        "digits": share("0-9"),
        "uppers": share("A-Z"),
        "marks": share(r"+/_=\-"),
        "classes": flag(candidate.rlike("[a-z]")) + flag(candidate.rlike("[A-Z]")) + flag(candidate.rlike("[0-9]")),
        "changes": (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) - 1) / n,
        "variety": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "pairs": 2 * F.regexp_count(low, F.lit(COMMON_PAIRS)) / n,
        "words": 1 - covered / n,
        "hexadecimal": flag(candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "issued": flag(candidate.rlike(ISSUED)),
        "slashes": n - F.length(F.replace(candidate, F.lit("/"), F.lit(""))),
        "in_path": flag(before.rlike(r"([/\\.~]|://[^\s]*)$")),
        "extension": flag(after.rlike(r"^\.[A-Za-z]{1,5}\b")),
        "repeats": flag(candidate.rlike(r"(.)\1{5}|(?i)(abcdef|123456|xxxx|example)")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(after.rlike("^[\"'`]")),
        "secret_cue": flag(before.rlike(f"(?i)({SECRET_CUES})[^\\s]{{0,16}}\\s{{0,2}}[=:]?\\s{{0,2}}[\"'`]?$")),
        "other_cue": flag(before.rlike(f"(?i)({OTHER_CUES})[^\\n]{{0,24}}$")),
    }
    return {k: made[k].cast("double") for k in FEATURES}


def labelled_findings(per_label: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """The built-in training set: (before, candidate, after, label), drawn from patterns of secrets and of look-alikes."""
    rng = random.Random(seed)
    pick = lambda alphabet, lo, hi: "".join(rng.choice(alphabet) for _ in range(rng.randint(lo, hi)))
    hexa, wide = "0123456789abcdef", string.ascii_letters + string.digits
    prose = lambda: " ".join(pick(string.ascii_lowercase, 2, 9) for _ in range(rng.randint(1, 5))) + rng.choice((" ", ", ", ". ", "\n"))
    case = lambda s: s.upper() if rng.random() < 0.25 else s
    rows = []
    for _ in range(per_label):
        name = rng.choice(("token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret", "private_key", "credential"))
        sign, mark = rng.choice((" = ", "=", ": ", ":")), rng.choice(('"', '"', "'", ""))
        body = rng.choice(
            (
                lambda: pick(hexa, 40, 40),
                lambda: pick(hexa, 32, 64),
                lambda: pick(wide, 20, 48),
                lambda: base64.b64encode(rng.randbytes(rng.randint(18, 40))).decode(),
                lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16),
                lambda: "ghp_" + pick(wide, 36, 36),
                lambda: "sk_live_" + pick(wide, 24, 24),
                lambda: "xoxb-" + pick(string.digits, 11, 12) + "-" + pick(wide, 24, 24),
                lambda: pick(string.ascii_letters, 20, 40),
                lambda: pick(wide, 10, 15),
                lambda: rng.choice(DICTIONARY) + str(rng.randint(1, 99)) + rng.choice(DICTIONARY).capitalize(),
            )
        )()
        issued = body[:4] in ("AKIA", "ghp_", "sk_l", "xoxb")
        context = prose() if issued and rng.random() < 0.4 else prose() + case(name + sign + mark)
        rows.append((context, body if issued else case(body), mark + rng.choice((" ", "\n", "###", "!!", "")), 1))
        lead, body, tail = rng.choice(
            (
                lambda: (rng.choice(("commit ", "sha1: ", "revision ")), pick(hexa, 40, 40), "\n"),
                lambda: (rng.choice(("md5: ", "checksum = ", "digest: ")), pick(hexa, 32, 32), " "),
                lambda: (rng.choice(("uuid: ", "id=", "")), "-".join(pick(hexa, k, k) for k in (8, 4, 4, 4, 12)), " "),
                lambda: ("", pick(string.digits, 16, 20), " "),
                lambda: ("call ", "".join(rng.choice(DICTIONARY).capitalize() for _ in range(3)) + pick(string.digits, 1, 3), "("),
                lambda: (rng.choice(("/", "./", "https://host.example/")), "/".join(rng.choice(DICTIONARY) for _ in range(3)) + pick(string.digits, 1, 4), rng.choice((".js", ".png", ".html"))),
                lambda: ("token = ", rng.choice(("your_token_here_", "EXAMPLE_TOKEN_", "xxxxxxxxxxxxxxxx")) + pick(string.digits, 2, 5), '"'),
                lambda: ("", pick(string.ascii_lowercase[:12], 16, 30) + pick(string.digits, 1, 2), " "),
                lambda: ("password: ", "_".join(rng.choice(DICTIONARY) for _ in range(3)) + pick(string.digits, 1, 1), "\n"),
                lambda: ("", "-".join((pick(string.digits, 4, 4), *(pick(string.digits, 2, 2) for _ in range(5)))), " "),
                lambda: ("", "".join(rng.choice(DICTIONARY) for _ in range(3)), " "),
                lambda: ("call ", "".join(rng.choice(DICTIONARY).capitalize() for _ in range(3)), "("),
                lambda: ("/", "/".join(rng.choice(DICTIONARY) for _ in range(4)), " "),
                lambda: ("", rng.choice("-_=") * rng.randint(16, 60), "\n"),
            )
        )()
        rows.append((prose() + lead, body, tail, 0))
    return rows


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree: a share of label 1, or (feature, threshold, tree up to it, tree above it)."""
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return float(y.mean())
    best = None
    for f in rng.choice(x.shape[1], 6, replace=False):
        values = np.unique(x[:, f])
        for cut in np.unique(np.quantile((values[1:] + values[:-1]) / 2, np.linspace(0, 1, 12))) if len(values) > 1 else ():
            low = x[:, f] <= cut
            n = low.sum()
            if LEAF <= n <= len(y) - LEAF:
                a, b = y[low].mean(), y[~low].mean()
                impurity = n * a * (1 - a) + (len(y) - n) * b * (1 - b)
                if best is None or impurity < best[0]:
                    best = impurity, int(f), float(cut), low
    if best is None:
        return float(y.mean())
    _, f, cut, low = best
    return f, cut, _grow(x[low], y[low], rng, depth - 1), _grow(x[~low], y[~low], rng, depth - 1)


def train_forest(spark: SparkSession, findings: list[tuple[str, str, str, int]] | DataFrame | None = None) -> list:
    """Trees trained on labelled findings (before, candidate, after, label), the built-in ones by default.

    From a table of findings, the LABELLED of either label whose hashes are smallest are learnt from, those
    with a null or a label other than 0 or 1 never.
    """
    if isinstance(findings, DataFrame):
        columns = ("before", "candidate", "after", "label")
        known = findings.select(*columns).where("label in (0, 1) and before is not null and candidate is not null and after is not null").distinct()
        order = F.xxhash64(*columns)
        findings = [tuple(r) for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(order, *columns).limit(LABELLED).collect()]
    findings = findings or labelled_findings()
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ",".join(f"({i},{quote(b)},{quote(c)},{quote(a)},{y})" for i, (b, c, a, y) in enumerate(findings))
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(i, before, candidate, after, label)")
    made = features(F.col("candidate"), F.col("before"), F.col("after"))
    rows = table.select("i", "label", *(c.alias(k) for k, c in made.items())).collect()
    rows.sort(key=lambda r: r["i"])
    x, y = np.array([[r[k] for k in FEATURES] for r in rows]), np.array([r["label"] for r in rows], float)
    rng = np.random.default_rng(SEED)
    return [_grow(x[s], y[s], rng, DEPTH) for s in (rng.integers(0, len(y), len(y)) for _ in range(TREES))]


def _vote(tree, columns: list[Column]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    f, cut, low, high = tree
    return F.when(columns[f] <= cut, _vote(low, columns)).otherwise(_vote(high, columns))


def scan_secrets(docs: DataFrame, forest: list | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, length, secret_sha256, score of every finding that the forest keeps.

    start counts code points from 0 in the whole text. Null and empty
    texts have no findings; repeated rows repeat theirs; an empty table gives no rows; columns of
    docs other than doc_id and text are left out. Work per text is linear in its length.
    """
    forest = forest or train_forest(docs.sparkSession)
    rows = docs.select("doc_id", "text").where(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", F.split("text", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    gap = lambda i: F.get("gaps", i)
    parts = F.transform(
        "found",
        lambda c, i: F.struct(c.alias("candidate"), F.right(gap(i), F.lit(BEFORE)).alias("before"), F.left(gap(i + 1), F.lit(AFTER)).alias("after"), F.length(gap(i)).alias("gap")),
    )
    # A row is exploded into its findings before positions are summed up, so that none carries the text along.
    exploded = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", parts.alias("parts")).select("row", "doc_id", F.posexplode("parts").alias("i", "x"))
    named = exploded.select("row", "doc_id", "i", "x.*")
    earlier = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("gap") + F.length("candidate")).cast("long")).over(earlier)
    found = named.select("doc_id", (end - F.length("candidate")).alias("start"), "candidate", "before", "after")
    made = features(F.col("candidate"), F.col("before"), F.col("after"))
    scored = found.select("doc_id", "start", "candidate", *(c.alias(k) for k, c in made.items()))
    columns = [F.col(k) for k in FEATURES]
    votes = [_vote(t, columns) for t in forest]
    score = sum(votes[1:], votes[0]) / len(votes)
    kept = scored.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"), F.round(score, 6).alias("score"))
    return kept.where(F.col("score") >= threshold)
