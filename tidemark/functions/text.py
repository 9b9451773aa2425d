"""Text scalars: subwords, line counts, literal search, slugs, rule packs; all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search leaves out.
SEARCH_STOP_WORDS = [
    "a", "an", "the", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "into", "is", "are", "was", "were", "it", "its", "or",
    "and", "be", "been", "this", "that", "these", "those", "then",
]
#: Words that comment comparison leaves out.
COMMENT_STOP_WORDS = [
    "the", "a", "an", "to", "if", "and", "of", "for", "in", "is", "it", "this", "that", "with", "from", "as", "on", "function", "const", "let", "var",
]
#: Patterns of secrets, template hygiene, self-evident assertions and assistant residue.
SECRET = r"""(['"])(?:sk-[a-zA-Z0-9_-]{24,}|ghp_[a-zA-Z0-9]{30,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z\-_]{35})\1"""
HTML_RULES = {
    "A11Y_IMAGE_MISSING_ALT": (r"(?i)<img\b(?![^>]*\balt\s*=)[^>]*>", None),
    "A11Y_CLICKABLE_NON_SEMANTIC": (r"""(?i)<(div|span)\b(?![^>]*\brole\s*=\s*['"](?:button|link|tab)['"])[^>]*\s(?:@click|v-on:click)\s*=""", None),
    "SECURITY_REVERSE_TABNABBING": (r"""(?i)<a\b[^>]*\btarget\s*=\s*["']_blank["'][^>]*>""", r"""(?i)\brel\s*=\s*["'][^"']*(?:noopener|noreferrer)[^"']*["']"""),
    "SECURITY_JAVASCRIPT_URL": (r"""(?i)\b(?:href|src|action|formaction)\s*=\s*["']\s*javascript:""", None),
    "SECURITY_RAW_HTML_INJECTION": (r"""\bv-html\s*=\s*["']""", r"(?i)(?:sanitize|DOMPurify|escapeHtml|filterXSS)"),
}
FAKE_GREEN = [
    r"expect\s*\(\s*(true|false|1|0)\s*\)\s*\.\s*to(?:Be|Equal|StrictEqual)\s*\(\s*\1\s*\)",
    r"assert\s*\.\s*(?:strictEqual|equal|deepEqual)\s*\(\s*(true|false|1|0)\s*,\s*\1\s*\)",
    r"assert\s*\.\s*ok\s*\(\s*(?:true|1)\s*\)",
    r"(?i)\bAssert\.(?:True|IsTrue)\s*\(\s*true\s*\)",
    r"(?i)\bAssert\.(?:False|IsFalse)\s*\(\s*false\s*\)",
    r"(?i)\bAssert\.(?:Equal|AreEqual)\s*\(\s*(true|false|1|0)\s*,\s*\1\s*\)",
    r"\bassert\s+(?:True|1\s*==\s*1)\b",
    r"\bself\.assert(?:True|Equal)\s*\(\s*(?:True|1\s*,\s*1)\s*\)",
    r"\bassert\.(?:True|Equal)\s*\(\s*t\s*,\s*(?:true|1\s*,\s*1)\s*\)",
]
RESIDUE = {
    "preamble": r"(?i)\b(?:here(?:'s| is) the (?:complete|updated|refactored|full) (?:code|implementation|file|component|version))\b",
    "residue": r"(?i)\b(?:hope this helps|feel free to tweak|let me know if you need|as you requested|as requested[,.!:]\s*(?:here|i\b|below)|as an ai language model)\b",
    "placeholder": r"(?i)\b(?:replace with your own|replace this with actual|insert your logic here)\b",
    "truncation": r"(?i)//\s*\.\.\.\s*(?:existing|rest of|remaining)\s+(?:code|implementation|logic|imports)",
    "fence": r"(?i)```(?:typescript|javascript|tsx|jsx|vue|js|ts|html|css)?\s*$",
}
COMMENT_START = r"^\s*(?://|#|\*|--|/\*|<!--)"


def subwords(c: Column) -> Column:
    """Lower-case parts of an identifier (camel case, acronyms, separators) longer than one character; null gives none."""
    s = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    s = F.regexp_replace(s, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    s = F.lower(F.regexp_replace(s, r"[-_./\\]+", " "))
    return F.filter(F.coalesce(F.split(s, r"\s+"), F.array().cast("array<string>")), lambda w: F.length(w) > 1)


def query_terms(c: Column) -> Column:
    """Subwords of a query without stop words; all subwords if nothing else is left."""
    words = subwords(c)
    kept = F.filter(words, lambda w: ~w.isin(SEARCH_STOP_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def line_count(c: Column) -> Column:
    """Lines as wc counts them, plus a last line without a break; empty text has none."""
    breaks = F.length(c) - F.length(F.translate(c, "\n", ""))
    return F.when(F.length(c) == 0, 0).otherwise(breaks + F.when(c.endswith("\n"), 0).otherwise(1))


def line_of(c: Column, index: Column) -> Column:
    """Line (from 1) of a zero-based character index."""
    head = F.substring(c, F.lit(1), index)
    return F.length(head) - F.length(F.translate(head, "\n", "")) + 1


def occurrences_of(c: Column, literal: str) -> Column:
    """Number of non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def matches_of(c: Column, pattern: str, is_regex: bool = False, ignore_case: bool = False) -> Column:
    """All matched substrings."""
    p = ("(?i)" if ignore_case else "") + (pattern if is_regex else "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    return F.regexp_extract_all(c, F.lit(p), F.lit(0))


def clamp_line(c: Column, limit: int = 1000) -> Column:
    """A line of at most ``limit`` characters and a note of how many are left out."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("… (+"), (F.length(c) - limit).cast("string"), F.lit(")"))).otherwise(c)


def slug(c: Column) -> Column:
    """Lower-case words joined by single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def at_handle(c: Column) -> Column:
    """Handle with exactly one leading @; blank is null."""
    bare = F.regexp_replace(F.trim(c), "^@+", "")
    return F.when(bare != "", F.concat(F.lit("@"), bare))


def is_secret_line(c: Column) -> Column:
    """A quoted key or token, outside comments, environment references and placeholders."""
    skipped = c.rlike(COMMENT_START) | c.contains("process.env") | c.contains("import.meta.env") | c.contains("dummy") | c.contains("placeholder")
    return c.rlike(SECRET) & ~skipped


def html_rules(c: Column) -> Column:
    """Names of the template rules a line breaks."""
    hits = []
    for name, (bad, excuse) in HTML_RULES.items():
        hit = c.rlike(bad) if excuse is None else c.rlike(bad) & ~c.rlike(excuse)
        hits.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*hits))


def is_fake_green(c: Column) -> Column:
    """A test line that asserts a literal against itself, outside comments."""
    hit = F.lit(False)
    for p in FAKE_GREEN:
        hit = hit | c.rlike(p)
    return hit & ~c.rlike(COMMENT_START)


def outside_string(line: Column, index: Column) -> Column:
    """Whether the zero-based ``index`` of a line lies outside quoted strings; whole-line comments have no strings."""
    head = F.substring(line, F.lit(1), index)
    bare = F.regexp_replace(head, r"\\.", "")
    closed = F.regexp_replace(bare, r""""[^"]*"|'[^']*'|`[^`]*`""", "")
    return line.rlike(r"^\s*(?://|#|\*|--)") | ~closed.rlike("[\"'`]")


def residue_kind(c: Column) -> Column:
    """First kind of assistant residue a line has outside strings; null for none."""
    out = F.lit(None).cast("string")
    for name, p in reversed(RESIDUE.items()):
        at = F.regexp_instr(c, F.lit(p)) - 1
        out = F.when((at >= 0) & outside_string(c, at), F.lit(name)).otherwise(out)
    return out


def comment_words(c: Column) -> Column:
    """Words of a comment or code line for comparison."""
    words = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(COMMENT_STOP_WORDS))


def regex_problem(pattern: str) -> str | None:
    """Why a pattern is refused (lookaround, back-reference, unbalanced), or null: those have no linear-time match."""
    i, depth, in_class = 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            if i + 1 >= len(pattern):
                return "trailing backslash"
            if not in_class and (pattern[i + 1] in "123456789" or pattern[i + 1] == "k"):
                return "back-reference"
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
            if pattern[i + 1 : i + 2] in ("]", "^") and pattern[i + 1 : i + 3] != "^]":
                i += 1
        elif ch == "(":
            depth += 1
            if pattern[i + 1 : i + 3] in ("?=", "?!") or pattern[i + 1 : i + 4] in ("?<=", "?<!"):
                return "lookaround"
        elif ch == ")":
            depth -= 1
            if depth < 0:
                return "unbalanced parenthesis"
        i += 1
    return "unbalanced class" if in_class else "unbalanced parenthesis" if depth else None
