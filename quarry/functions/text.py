"""Text functions as columns: tokens, hashes, paths, profiles and secrets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with accents, and the letters that they are searched as.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}]+"
# Phrases of questions, by what they ask for, words that ask for the present, and words that say nothing.
SECRET_PHRASES = [
    "api key", "credential", "credentials", "password", "passphrase", "private key", "recovery code", "rotation code",
    "secret", "access token", "api token", "auth token", "bearer token", "token value",
]
HISTORICAL_PHRASES = ["before ", "formerly", "historical", "history", "previously", "prior to", "used to", "why was"]
CURRENT_TERMS = ["accepted", "current", "currently", "latest", "now", "recent", "recently", "today"]
RELATIONAL_PHRASES = [
    "connected to", "connected with", "depend on", "depends on", "linked to", "managed by", "manages", "owned by", "owns",
    "powered by", "powers", "rack that", "related to", "reports to", "which host", "which rack", "which service", "who manages",
    "who owns",
]
STOP_WORDS = [
    "a", "about", "an", "and", "are", "at", "be", "by", "can", "did", "do", "does", "for", "from", "how", "in", "is", "it", "me", "of",
    "on", "please", "should", "tell", "the", "this", "to", "was", "were", "what", "when", "where", "which", "who", "why", "will",
    "with", "would",
]
PERSONAL_TERMS, WORK_TERMS = ["personal"], ["work", "workspace", "company"]
# Tags by what they say of a concept.
SENSITIVE_TAGS = ["credential", "credentials", "secret", "secrets"]
STALE_TAGS = ["conflicting", "historical", "obsolete", "stale"]
STALE_STATES = ["deprecated", "tombstone"]
# Shapes of secrets, in any case.
SECRETS = [
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"(?:api|secret|access)[_-]?key\s*[:=]\s*[A-Za-z0-9_\-]{16,}",
    r"(?:token|bearer)\s*[:=]\s*[A-Za-z0-9_\-]{16,}",
    r"-----BEGIN [A-Z ]+PRIVATE KEY-----",
]


def fold(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Letters and digits, lower case, accents folded; all else separates."""
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens(); folding accents turns letters to letters, so counts need none of it."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN))


def namespace(path: Column) -> Column:
    """/first-segment/, or / for a path without one."""
    first = F.get(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(0))
    return F.when(first.isNull(), F.lit("/")).otherwise(F.concat(F.lit("/"), first, F.lit("/")))


def reserved(path: Column) -> Column:
    """Paths of generated or asset files, which aren't concepts."""
    return path.startswith("/.assets/") | path.rlike(r"(^|/)(index\.md|\.memory-schema\.json)$") | (path == "/log.md")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def snippet(text: Column, width: int = 240) -> Column:
    """The first characters of a text, blanks squeezed; the rest is squeezed only where the first eight times as many have too few."""
    ahead = squeeze(F.substring(text, 1, 8 * width))
    return F.substring(F.when(F.length(ahead) > width, ahead).otherwise(squeeze(text)), 1, width)


def escaped(text: Column) -> Column:
    """Markdown's own characters with a backslash before each."""
    return F.regexp_replace(text, r"([\\\[\]()*_`#>|])", r"\\$1")


def embedding_text(title: Column, description: Column, body: Column) -> Column:
    """The text that is embedded: title, description and body, trimmed, those that aren't empty parted by a blank line."""
    return F.concat_ws("\n\n", *[F.nullif(F.trim(x), F.lit("")) for x in (title, description, body)])


def link_path(href: Column) -> Column:
    return F.substring_index(href, "#", 1)


def link_anchor(href: Column) -> Column:
    return F.when(F.instr(href, "#") > 0, F.nullif(F.regexp_replace(href, r"^[^#]*#", ""), F.lit("")))


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    share = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def has_secret(text: Column, length: int = 32, bits: float = 3.5) -> Column:
    """Whether a text has the shape of a secret, or a long word of high entropy; a null text has none."""
    shape = F.lit(False)
    for pattern in SECRETS:
        shape = shape | text.rlike("(?i)" + pattern)
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/=_-]{%d,}" % length), F.lit(0))
    return F.coalesce(shape | F.exists(words, lambda w: entropy(w) >= bits), F.lit(False))


def any_of(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for x in phrases:
        out = out | text.contains(x)
    return out


def normalised_question(q: Column) -> Column:
    return F.lower(squeeze(q))


def question_profile(q: Column) -> Column:
    """What a question asks for: struct(secret, temporal, relational, namespace, terms); terms are in the question's order, each once, joined by spaces."""
    q = normalised_question(q)
    words = F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    some = lambda names: F.arrays_overlap(words, F.array(*[F.lit(x) for x in names]))
    temporal = F.when(any_of(q, HISTORICAL_PHRASES), "historical").when(some(CURRENT_TERMS), "current").otherwise("neutral")
    space = F.when(some(PERSONAL_TERMS), "personal").when(some(WORK_TERMS), "work").otherwise("")
    terms = F.array_join(F.array_distinct(F.filter(words, lambda w: ~w.isin(STOP_WORDS))), " ")
    return F.struct(any_of(q, SECRET_PHRASES).alias("secret"), temporal.alias("temporal"), any_of(q, RELATIONAL_PHRASES).alias("relational"), space.alias("namespace"), terms.alias("terms"))


def semver(v: Column) -> Column:
    """struct(major, minor, patch) of a strict version, else null."""
    ok = v.rlike(r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)$")
    parts = F.split(v, r"\.")
    return F.when(ok, F.struct(*[F.element_at(parts, i).cast("int").alias(n) for i, n in ((1, "major"), (2, "minor"), (3, "patch"))]))


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp as it's written, whatever the session's zone."""
    return (F.datediff(F.to_date(ts), F.lit("1970-01-01")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")
