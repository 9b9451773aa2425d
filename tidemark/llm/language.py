"""Languages of documents and of their segments by Kneser-Ney character models.

Per language an interpolated Kneser-Ney model over characters is fitted on a bounded sample of labelled documents and kept in
sorted arrays of n-gram hashes. A unit of text (sentence, list entry, comment text) gets the language of lowest
length-normalised cross-entropy, unless it is rejected by bounds calibrated on held-out units: code and unknown languages.
"""

from __future__ import annotations

import io
import re
import unicodedata
from bisect import bisect_right
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.normalize import trim_unicode
from tidemark.runtime import ensure_checkpoint_dir, require_columns, spread

#: Codes and English names of the eight languages.
LABELS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german"],
    "fr": ["fr", "fra", "fre", "french"],
    "es": ["es", "spa", "spanish", "castilian"],
    "pt": ["pt", "por", "portuguese"],
    "it": ["it", "ita", "italian"],
    "nl": ["nl", "nld", "dut", "dutch"],
    "ru": ["ru", "rus", "russian"],
}
LANGS = list(LABELS)
ORDER = 5
#: The models are fitted on about this many labelled documents per language (by hash of the id), none longer than SAMPLE_CHARS, and
#: of each language on no more than SAMPLE_TOTAL characters.
SAMPLE_DOCS = 400
SAMPLE_CHARS = 20_000
SAMPLE_TOTAL = 600_000
#: Letters a unit needs to get a language of its own; shorter ones neither make nor break a run.
MIN_LETTERS = 12
#: Nats per character that are never rejected.
MIN_BOUND = 3.3
#: Posterior below which a unit stays undecided.
MIN_POSTERIOR = 0.9
#: An n-gram is taken for a stray of wrong labels below this share of its frequency in another language; the first holds while labels are raw.
RAW_STRAY_SHARE = 0.4
STRAY_SHARE = 0.05
#: Units in a row that make a language part of a document.
MIN_RUN = 2
_ALPHABET = 256.0
_PAD = "\x02" * (ORDER - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def label_language(c):
    """Two-letter code of a label: code or English name, any case, region suffix or not; null where it names none of the eight."""
    word = F.regexp_extract(F.lower(trim_unicode(c)), r"^([a-z]+)(?:[-_ .(].*)?$", 1)
    out = F.lit(None).cast("string")
    for lang, names in LABELS.items():
        out = F.when(word.isin(names), lang).otherwise(out)
    return out


# ---- text units

_BYTE = {bytes([b]).decode("cp1252"): b for b in range(128, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {chr(b): b for b in range(128, 256)}
_HIGH = re.compile(f"[{re.escape(''.join(_BYTE))}]{{2,}}")
_QUOTED = re.compile(r"""[(\[]?(?:"[^"\n]{1,90}"|“[^”\n]{1,90}”|„[^“”\n]{1,90}[“”]|«[^»\n]{1,90}»|`[^`\n]{1,90}`|(?<!\w)'[^'\n]{1,90}'(?!\w))[)\]]?""")
_QUOTE = re.compile("[\"“„«`']")
#: What makes the word it is in an identifier.
_IDENTIFIER = re.compile(r"[A-Za-z]_[A-Za-z]|[a-z][A-Z]|[A-Za-z0-9]/[A-Za-z0-9]|\w\.\w+\(|://|\w@\w|\d[A-Za-z]|[A-Za-z]\d")
_COMMENT = re.compile(r"^\s*(?://+!?|#+(?!\w)|\*+(?!/)|--+|/\*+|<!--|>+|%+|;+|\"\"\"|''')(?:\s+|$)")
_LIST = re.compile(r"^\s*(?:(?:[-+•–·]\s+)?\[[ xX]?\]|[-+•–·]|\d{1,3}[.)])\s+")
_LOG = re.compile(r"^\s*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?|\d{4}-\d{2}-\d{2}[T ]|\[?(?:INFO|WARN|ERROR|DEBUG|OK|FAIL|SKIP)\b)")
_CODE_START = re.compile(
    r"^\s*(?:(?:const|let|var|def|class|function|import|export|from|return|elif|else|try|except|while|public|private|static|package|using|async|await)\b.*[({;=:\[\]})\"']"
    r"|(?:if|for|switch)\s*\(|(?:SELECT|INSERT|UPDATE|DELETE|CREATE)\s.*\b(?:FROM|INTO|SET|TABLE)\b|\$\s|[.#@]?[\w-]+\s*\{|[})\]]+[;,]?\s*$|</?[A-Za-z])"
)
_CODE_MARK = re.compile(r"[{}\[\]<>=$|\\^~]|\(\)|;\s*$|=>|::|->")
_SPLIT = re.compile(r"(?<=[.!?…;。？！])[\"'”»)\]]*\s+")
_INVISIBLE = dict.fromkeys([0x200B, 0x2060, 0x00AD, 0xFEFF])
_MARKS = re.compile("[\u200b\u2060\u00ad\ufeff]")
_NOT_LETTER = re.compile(r"[\W\d_]+")
_NUMBER = re.compile(r"^\s*#\d+\s+")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")


def repair_bytes(text: str) -> tuple[str, list[int], list[int]]:
    """UTF-8 that was read as a single-byte code page, put right run by run; anything else stays.

    The two lists say how places of the result map to ``text``: from each of the first on, add the second.
    """
    if text.isascii():
        return text, [], []
    parts, places, shifts, at, size, shift = [], [], [], 0, 0, 0
    for m in _HIGH.finditer(text):
        try:
            fixed = bytes(_BYTE[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            continue
        parts += [text[at : m.start()], fixed]
        size += m.start() - at + len(fixed)
        shift += m.end() - m.start() - len(fixed)
        at = m.end()
        places.append(size)
        shifts.append(shift)
    return "".join([*parts, text[at:]]) if parts else text, places, shifts


def letters_of(unit: str) -> str:
    """Lower-case words of a unit, without quoted phrases, identifiers, digits and marks."""
    if not unit.isascii():
        unit = unicodedata.normalize("NFKC", unit.translate(_INVISIBLE) if _MARKS.search(unit) else unit)
    if _QUOTE.search(unit):
        unit = _QUOTED.sub(" ", unit)
    if _IDENTIFIER.search(unit):
        unit = " ".join(w for w in unit.split() if not _IDENTIFIER.search(w))
    return _NOT_LETTER.sub(" ", unit.lower()).strip()


def is_code(line: str) -> bool:
    """Whether a line without comment mark is code, a log entry or markup, judged by its form alone."""
    if _LOG.match(line) or _CODE_START.match(line):
        return True
    bare = _QUOTED.sub(" ", line) if _QUOTE.search(line) else line
    return len(_CODE_MARK.findall(bare)) * 12 >= max(1, len(line.strip()))


@dataclass
class Unit:
    """A sentence or list entry: its raw text, words, number of whole comment lines it covers, what precedes it, and its place in the document."""

    text: str
    words: str
    lines: int = 1
    after_code: bool = False
    start: int = 0
    end: int = 0


def units_of(text: str | None) -> list[Unit]:
    """Units of prose in order. Lines of one paragraph or comment flow together; list entries stand alone; code breaks the flow."""
    out: list[Unit] = []
    flow: list[str] = []
    starts: list[int] = []
    kind = ""
    broken = False
    whole, places, shifts = repair_bytes(text or "")

    def place(p: int) -> int:
        i = bisect_right(places, p)
        return p + shifts[i - 1] if i else p

    def close():
        nonlocal broken
        if not flow:
            return
        joined, begins = flow[0], [0]
        for more in flow[1:]:
            begins.append(len(joined) + 1)
            joined = f"{joined} {more}"
        ends = [(m.start(), m.end()) for m in _SPLIT.finditer(joined)] + [(len(joined), len(joined))]
        pieces, at = [], 0
        for end, then in ends:
            if joined[at:end].strip():
                pieces.append((at, end))
            at = then
        for a, z in pieces:
            i, j = bisect_right(begins, a) - 1, bisect_right(begins, z - 1) - 1
            p = joined[a:z]
            out.append(Unit(p, letters_of(p), len(flow) if kind == "comment" and len(pieces) == 1 else 1, broken, place(starts[i] + a - begins[i]), place(starts[j] + z - begins[j])))
            broken = False
        flow.clear()
        starts.clear()

    at = 0
    for stop, then in [*((m.start(), m.end()) for m in _BREAK.finditer(whole)), (len(whole), len(whole))]:
        line, begin, at = whole[at:stop], at, then
        if not line.strip():
            if kind != "plain":
                close()
                kind = ""
            continue
        bare, now = line, "plain"
        if m := _COMMENT.match(line):
            bare, now = line[m.end():], "comment"
        elif m := _LIST.match(line):
            bare, now = line[m.end():], "list"
        if now == "plain" and is_code(bare) or now == "comment" and _CODE_START.match(bare) and is_code(bare):
            close()
            kind, broken = "", True
            continue
        # Only what precedes it was taken off so far.
        bare = _NUMBER.sub("", bare).lstrip()
        begin += len(line) - len(bare)
        bare = bare.rstrip()
        if now != kind or now == "list":
            close()
        kind = now
        if bare:
            flow.append(bare)
            starts.append(begin)
    close()
    return out


# ---- models


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all units behind pads, and the unit of each (-1 at pads)."""
    text = "".join(f"{_PAD} {u} " for u in units)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(u) + 2 + len(_PAD) for u in units], dtype=np.int64)
    unit = np.repeat(np.arange(len(units)), lengths)
    return codes, np.where(codes == 2, -1, unit)


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Hash of the k characters that end at each position, for k = 0 .. ORDER."""
    out = [np.zeros(len(codes), dtype=np.uint64)]
    with np.errstate(over="ignore"):
        for _ in range(ORDER):
            context = np.concatenate([out[-1][:1] * np.uint64(0), out[-1][:-1]])
            out.append((context + codes + np.uint64(1)) * _MULTIPLIER ^ ((context + codes) >> np.uint64(29)))
    return out


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted hash in the sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


@dataclass
class LanguageModels:
    """Models of all languages over shared sorted hash arrays: keys[k] with logs[k] (one column per language), and back-off logs."""

    langs: list[str]
    keys: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backs: list[np.ndarray] = field(default_factory=list)
    #: Per language: cross-entropy above which a unit is rejected.
    bound: np.ndarray | None = None

    def entropies(self, units: list[str]) -> np.ndarray:
        """Nats per character of each unit under each language; inf for units without letters."""
        if not units:
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        out = np.full((len(units), len(self.langs)), np.inf, dtype=np.float32)
        codes, unit = _codes(units)
        hashes = _grams(codes)
        real = np.flatnonzero(unit >= 0)
        total = np.zeros((len(real), len(self.langs)), dtype=np.float32)
        left = np.arange(len(real))
        for k in range(ORDER, 0, -1):
            at = _lookup(self.keys[k], hashes[k][real[left]])
            hit = at >= 0
            total[left[hit]] += self.logs[k][at[hit]]
            left = left[~hit]
            if not len(left):
                break
            # The context of a k-gram is the (k-1)-gram that ends one character earlier.
            back = _lookup(self.contexts[k], hashes[k - 1][np.maximum(real[left] - 1, 0)])
            known = back >= 0
            total[left[known]] += self.backs[k][back[known]]
        total[left] -= np.log(_ALPHABET)
        owner = unit[real]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        sums = np.add.reduceat(total, first, axis=0)
        sizes = np.diff(np.append(first, len(owner)))[:, None]
        out[owner[first]] = -sums / sizes
        return out

    def classify(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(language index, posterior) of each unit; -1 undecided (too short or close), -2 rejected (no language known here)."""
        h = self.entropies(units)
        if not len(h):
            return np.zeros(0, dtype=int), np.zeros(0)
        size = np.array([len(u) + 2 for u in units], dtype=np.float64)
        letters = np.array([len(u) - u.count(" ") for u in units])
        best = h.argmin(axis=1)
        low = h.min(axis=1)
        # Characters of one word depend on each other, so a fraction of the length counts as evidence.
        gap = (h - low[:, None]) * np.minimum(size, 200)[:, None] * 0.25
        posterior = 1.0 / np.exp(-np.minimum(gap, 50)).sum(axis=1)
        lang = np.where(low > self.bound[best], -2, best)
        lang = np.where((letters < MIN_LETTERS) | ((posterior < MIN_POSTERIOR) & (lang >= 0)), -1, lang)
        return lang, posterior


def _counts(units: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order 1 .. ORDER: distinct n-gram hashes, their contexts' hashes, their suffixes' hashes and their counts."""
    codes, unit = _codes(units)
    hashes = _grams(codes)
    real = np.flatnonzero(unit >= 0)
    out = []
    for k in range(1, ORDER + 1):
        keys, first, n = np.unique(hashes[k][real], return_index=True, return_counts=True)
        at = real[first]
        out.append((keys, hashes[k - 1][at - 1], hashes[k - 1][at], n.astype(np.float64)))
    return out


def _without_strays(tables: dict, share: float) -> dict:
    """Per language the n-grams that are at least ``share`` times as frequent there as in the language that has them most.

    Units under a wrong label bring whole sentences into a language's model, which then predicts them better than their own
    language's model, as nothing else follows those contexts there. Such n-grams are rare against their own language.
    """
    out = {lang: [] for lang in tables}
    for k in range(ORDER):
        keys = np.unique(np.concatenate([t[k][0] for t in tables.values()]))
        most = np.zeros(len(keys))
        for t in tables.values():
            at = np.searchsorted(keys, t[k][0])
            most[at] = np.maximum(most[at], t[k][3] / t[0][3].sum())
        for lang, t in tables.items():
            keep = t[k][3] / t[0][3].sum() >= share * most[np.searchsorted(keys, t[k][0])]
            if k:  # a suffix or context that was dropped drops its longer n-grams
                keep &= (_lookup(out[lang][k - 1][0], t[k][2]) >= 0) & (_lookup(out[lang][k - 1][0], t[k][1]) >= 0)
            out[lang].append(tuple(x[keep] for x in t[k]))
    return out


def fit_models(samples: dict[str, list[str]], stray_share: float = STRAY_SHARE) -> LanguageModels:
    """Interpolated Kneser-Ney models of the units (words as by ``letters_of``) of each language."""
    langs = [lang for lang in LANGS if samples.get(lang)]
    model = LanguageModels(langs)
    tables = _without_strays({lang: _counts(samples[lang]) for lang in langs}, stray_share)
    model.keys, model.logs, model.contexts, model.backs = ([np.zeros(0, dtype=np.uint64)] for _ in range(4))
    lower = None
    for k in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([tables[lang][k - 1][0] for lang in langs]))
        contexts = np.unique(np.concatenate([tables[lang][k - 1][1] for lang in langs]))
        # Of every n-gram of any language: context and suffix, for back-off in the languages that lack it.
        context_of, suffix_of = np.zeros(len(keys), dtype=np.uint64), np.zeros(len(keys), dtype=np.uint64)
        for lang in langs:
            own, ctx, suf, _ = tables[lang][k - 1]
            at = np.searchsorted(keys, own)
            context_of[at], suffix_of[at] = ctx, suf
        logs, backs = np.zeros((len(keys), len(langs))), np.zeros((len(contexts), len(langs)))
        for j, lang in enumerate(langs):
            own, ctx, _, n = tables[lang][k - 1]
            if k < ORDER:  # continuation counts: how many distinct characters precede the n-gram
                n = np.bincount(_lookup(own, tables[lang][k][2]).clip(0), minlength=len(own)).astype(np.float64)
                n = np.maximum(n, 1)
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1.0, ones + 2.0 * twos)))
            where = np.searchsorted(contexts, ctx)
            mass, kinds = np.bincount(where, n, len(contexts)), np.bincount(where, minlength=len(contexts))
            back = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0)
            at = np.searchsorted(keys, own)
            direct = np.zeros(len(keys))
            direct[at] = np.maximum(n - discount, 0) / mass[where]
            below = np.full(len(keys), 1 / _ALPHABET) if k == 1 else np.exp(lower[0][np.searchsorted(lower[1], suffix_of), j])
            logs[:, j] = np.log(direct + back[np.searchsorted(contexts, context_of)] * below)
            backs[:, j] = np.log(back)
        lower = (logs, keys)
        model.keys.append(keys)
        model.logs.append(logs.astype(np.float32))
        model.contexts.append(contexts)
        model.backs.append(backs.astype(np.float32))
    return model


def calibrate(model: LanguageModels, held: dict[str, list[str]], quantile: float = 0.999, slack: float = 1.15) -> LanguageModels:
    """Set each language's bound of rejection: the quantile of held-out units' cross-entropy times ``slack``, at least MIN_BOUND."""
    bounds = []
    for j, lang in enumerate(model.langs):
        units = [u for u in held.get(lang, []) if len(u) >= 2 * MIN_LETTERS]
        h = model.entropies(units)[:, j] if units else np.zeros(1)
        bounds.append(max(MIN_BOUND, slack * float(np.quantile(h, quantile))))
    model.bound = np.array(bounds)
    return model


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def train_models(labelled: list[tuple[str, str]]) -> LanguageModels:
    """Models of (language, text) documents. Labels may be wrong: units that first models give to another language are dropped.

    Every fifth document is held out for calibration. Copies without accents are added, as texts may have lost them.
    """
    docs = sorted({(lang, text) for lang, text in labelled if lang in LABELS and text})
    units = [[u.words for u in units_of(text) if len(u.words) >= MIN_LETTERS] for _, text in docs]
    owner = np.repeat(np.arange(len(docs)), [len(u) for u in units])
    flat = [u for own in units for u in own]
    label = np.array([LANGS.index(lang) for lang, _ in docs], dtype=int)
    if not flat:
        return calibrate(LanguageModels([]), {})

    def pick(keep: np.ndarray, given: np.ndarray) -> dict[str, list[str]]:
        return {lang: [flat[i] for i in np.flatnonzero(keep & (given == j))] for j, lang in enumerate(LANGS)}

    keep, share = np.ones(len(flat), dtype=bool), RAW_STRAY_SHARE
    for _ in range(3):
        model = fit_models(pick(keep, label[owner]), share)
        said = np.array([LANGS.index(lang) for lang in model.langs])[model.entropies(flat).argmin(axis=1)]
        # A document takes the language of most of its units; units of another language in it are left out.
        votes = np.zeros((len(docs), len(LANGS)))
        np.add.at(votes, (owner, said), 1)
        label, keep, share = votes.argmax(axis=1), said == votes.argmax(axis=1)[owner], STRAY_SHARE
    held = keep & (owner % 5 == 4)
    fit = pick(keep & ~held, said)
    plain = {lang: own + [b for u in own if (b := _bare(u)) != u and lang != "ru"] for lang, own in fit.items()}
    return calibrate(fit_models(plain), pick(held, said))


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS, total_chars: int = SAMPLE_TOTAL) -> list[tuple[str, str]]:
    """About ``per_language`` labelled documents of each language in order of the hash of doc_id, up to ``total_chars`` of each.

    Documents longer than ``max_chars`` are not sampled. The sample only fits the models; all documents are classified.
    """
    known = docs.select("doc_id", "text", label_language(F.col("lang")).alias("known")).where(F.col("known").isNotNull() & F.length("text").between(20, max_chars))
    counts = {r["known"]: r["n"] for r in known.groupBy("known").agg(F.count("*").alias("n")).collect()}  # at most one row per language
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("known") == lang, int(min(1.0, per_language / n) * 1_000_000)).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    out, used = [], dict.fromkeys(LANGS, 0)
    # The sample is bounded, so it is ordered here rather than by a sort of the cluster, which would scan once more.
    for _, _, lang, text in sorted(tuple(r) for r in picked.select(F.xxhash64("doc_id"), "doc_id", "known", "text").toLocalIterator()):
        if used[lang] < total_chars:
            out.append((lang, text))
            used[lang] += len(text)
    return out


def _packed(model: LanguageModels) -> bytes:
    out = io.BytesIO()
    arrays = {f"{name}{k}": x for name in ("keys", "logs", "contexts", "backs") for k, x in enumerate(getattr(model, name))}
    np.savez_compressed(out, langs=np.array(model.langs, dtype="U2"), bound=model.bound, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> LanguageModels:
    with np.load(io.BytesIO(data), allow_pickle=False) as f:
        model = LanguageModels([str(x) for x in f["langs"]], bound=f["bound"])
        for name in ("keys", "logs", "contexts", "backs"):
            setattr(model, name, [f[f"{name}{k}"] for k in range(sum(x.startswith(name) for x in f.files))])
    return model


_FITTED: dict[str, LanguageModels] = {}


def shared_models(docs: DataFrame) -> LanguageModels:
    """``train_models`` of ``labelled_sample(docs)``, fitted once for a sample and kept by a digest of it, in this process and in the checkpoint folder."""
    spark, sample = docs.sparkSession, labelled_sample(docs)
    digest = blake2b(digest_size=16)
    for part in (ORDER, MIN_LETTERS, MIN_BOUND, RAW_STRAY_SHARE, STRAY_SHARE, *sample):
        digest.update(repr(part).encode("utf-8", "surrogatepass"))
    key = digest.hexdigest()
    if key not in _FITTED:
        ensure_checkpoint_dir(spark)
        # The parent of the session's own checkpoint folder, so that sessions share it.
        folder = f"{spark.sparkContext.getCheckpointDir().rpartition('/')[0]}/tidemark-language-models/{key}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            _FITTED[key] = _unpacked(bytes(spark.read.parquet(folder).first()["model"]))
        else:
            _FITTED[key] = train_models(sample)
            spark.createDataFrame([(_packed(_FITTED[key]),)], "model binary").coalesce(1).write.mode("overwrite").parquet(folder)
    return _FITTED[key]


# ---- documents

SEGMENTS = "doc_id long, label string, segment int, lang string, n_units int, n_lines int, confidence double, start_char int, end_char int, text string"


def language_segments(docs: DataFrame, model: LanguageModels | None = None, with_text: bool = False) -> DataFrame:
    """Segments of ``docs`` (doc_id LONG, text, lang): runs of units of one language, with confidence.

    ``model`` is that of ``shared_models(docs)`` if not given. Undecided units neither make nor break a run; rejected units and code
    do break it. Null, empty or blank texts and texts without a known language have no segments. Repeated rows give repeated
    segments. Extra columns are ignored. Result: doc_id, label, segment (from 0), lang, n_units, n_lines (comment lines
    of a single-sentence comment), confidence (mean posterior), start_char and end_char (place in the text in code points, from 0, the end
    not included) and text (of its units, where asked for).
    """
    require_columns(docs, ["doc_id", "text", "lang"])
    if model is None:
        model = shared_models(docs)
    if not model.langs:
        return docs.sparkSession.createDataFrame([], SEGMENTS)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            for start in range(0, len(b), 500):
                yield _segments(b.iloc[start : start + 500], m, with_text)

    return spread(docs.select("doc_id", "text", "lang").where("text IS NOT NULL")).mapInPandas(run, SEGMENTS)


def _segments(b: pd.DataFrame, m: LanguageModels, with_text: bool) -> pd.DataFrame:
    split = [units_of(t) for t in b["text"]]
    lang, post = m.classify([u.words for units in split for u in units])
    rows, at = [], 0
    for doc, label, units in zip(b["doc_id"], b["lang"], split):
        runs: list[list] = []  # language, units, lines, posteriors, texts
        fresh = True
        for u in units:
            j, p = lang[at], post[at]
            at += 1
            fresh |= u.after_code or j == -2
            if j < 0:
                continue
            if fresh or not runs or runs[-1][0] != j:
                runs.append([j, 0, 0, [], [], u.start, u.end])
            fresh = False
            r = runs[-1]
            r[1], r[2] = r[1] + 1, max(r[2], u.lines)
            r[3].append(p)
            r[6] = u.end
            if with_text:
                r[4].append(u.text)
        rows += [(doc, label, i, m.langs[j], n, lines, float(np.mean(p)), a, z, " ".join(t)) for i, (j, n, lines, p, t, a, z) in enumerate(runs)]
    return pd.DataFrame(rows, columns=["doc_id", "label", "segment", "lang", "n_units", "n_lines", "confidence", "start_char", "end_char", "text"])


def document_languages(docs: DataFrame, model: LanguageModels | None = None) -> DataFrame:
    """Languages of every document of ``docs``: doc_id, label, lang, confidence, n_languages, one row per language in the document.

    A language is in a document if a run has at least MIN_RUN units of it, or a comment of one sentence covers as many lines.
    """
    runs = language_segments(docs, model).where((F.col("n_units") >= MIN_RUN) | (F.col("n_lines") >= MIN_RUN))
    per = runs.groupBy("doc_id", "label", "lang").agg((F.sum(F.col("confidence") * F.col("n_units")) / F.sum("n_units")).alias("confidence"))
    count = per.groupBy("doc_id", "label").agg(F.collect_list(F.struct("lang", "confidence")).alias("found"))  # at most eight each
    return count.select("doc_id", "label", F.size("found").alias("n_languages"), F.explode("found").alias("f")).select("doc_id", "label", "f.lang", "f.confidence", "n_languages")


def mislabelled(languages: DataFrame) -> DataFrame:
    """(doc_id, lang) of documents whose label is absent, unusable or of another language than their only one, or that hold several."""
    known = label_language(F.col("label"))
    return languages.where((F.col("n_languages") > 1) | known.isNull() | (known != F.col("lang"))).select("doc_id", "lang").distinct()
