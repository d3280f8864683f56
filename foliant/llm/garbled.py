"""Texts that were decoded with a wrong character encoding (problem 8).

A wrong decoding is a substitution cipher: the letter that was written stands as the letter, or letters, that another code page has for its
bytes. Which ciphers a source's texts went through is learned by expectation-maximization against the letter bigrams and word counts of the language:

* Known ciphers are the pairs of a written and a read code page, each a table for translate(). Every text has a probability for each of them, and
  from these come each source's frequency of each cipher and, with the garbled texts left out, the bigrams and counts of the next round.
* Every source has one free table besides, for a page that no pair explains. It is learned from the bigrams around the odd characters of what is left,
  letter by letter, with the known pairs as a weak prior, and applied with translate(); what it makes must be words that occur elsewhere.

Only tokens with a character beyond ASCII take part; the others are the same under every cipher. Distinct tokens are looked at once, and only texts
with a token that some cipher improves are scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import source_key
from foliant.session import saved

# fixed values: code pages (Python's names) that texts were written or read in
UTF8_READ_AS = ["cp1252", "latin-1", "cp437", "cp850", "cp852", "cp866", "cp1250", "cp1251", "cp1254", "koi8-r", "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-15", "gb18030", "shift_jis", "big5"]
TWICE = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251"]
WEST = ["cp1252", "cp850", "cp437", "mac_roman"]
CENTRAL = ["cp1250", "iso8859-2", "cp852", "mac_latin2"]
CYRILLIC = ["cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic"]
_MULTI = {"gb18030", "shift_jis", "big5"}
_RUN = re.compile(r"[^\x00-\x7f]+")
LOST = "�"
CLASSES, SKETCH, BAD = 1664, 1 << 18, -12.0
#: Log-probability below which a bigram is a rare one.
ODD = -4.0
FREE = "a page learned for the source"


def _page(name: str) -> dict[int, str]:
    """Characters of the bytes 128..255; bytes that the page leaves out stand for themselves."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(name)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


def letter_classes(text: str) -> np.ndarray:
    """Bounded classes of the characters: those below 0x600 (digits as one) by themselves, all others hashed."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    x = np.where(x < 0x600, x, 0x600 + x % (CLASSES - 0x600))
    return np.where((x >= 48) & (x <= 57), 48, x)


class Ciphers:
    """All ciphers, each undone by undo(number, text): the written text, or None where the text can't have come from it."""

    def __init__(self) -> None:
        pages = {n: _page(n) for n in {*UTF8_READ_AS, *WEST, *CENTRAL, *CYRILLIC, "latin-1"} - _MULTI}
        self._bytes = {n: {ord(c): chr(b) for b, c in p.items()} for n, p in pages.items()}
        single = [(w, r) for group in (WEST, CENTRAL, CYRILLIC) for w in group for r in group if w != r]
        single += [(w, r) for w in CENTRAL + CYRILLIC for r in [*WEST, "latin-1"]] + [(w, r) for w in ["cp1252"] for r in [*CENTRAL, *CYRILLIC, "latin-1"]]
        self.names = [f"utf-8 as {r}" for r in UTF8_READ_AS] + [f"utf-8 as {r} twice" for r in TWICE] + [f"{w} as {r}" for w, r in single]
        self.multi = [any(m in n for m in _MULTI) for n in self.names]
        self._tables = [{ord(c): pages[w][b] for b, c in pages[r].items()} for w, r in single]
        self._known = [set(map(chr, t)) for t in self._tables]
        # letter class of what stands for each character under each single-byte cipher, -1 where nothing does
        self.first_single = len(self.names) - len(single)
        self.classes = np.full((len(single), 0x10000), -1, np.int16)
        self.classes[:, :128] = letter_classes("".join(map(chr, range(128))))
        for k, table in enumerate(self._tables):
            at = np.array([char for char in table if char < 0x10000])
            lower = [letter.lower()[:1] for char, letter in table.items() if char < 0x10000]
            self.classes[k, at] = letter_classes("".join(lower))

    def _unread(self, text: str, page: str) -> str | None:
        try:
            raw = text.encode(page) if page in _MULTI else text.translate(self._bytes[page]).encode("latin-1")
            return raw.decode("utf-8")
        except UnicodeError:
            return None

    def undo(self, number: int, text: str) -> str | None:
        if number < len(UTF8_READ_AS):
            return self._unread(text, UTF8_READ_AS[number])
        number -= len(UTF8_READ_AS)
        if number < len(TWICE):
            once = self._unread(text, TWICE[number])
            return None if once is None or once.isascii() else self._unread(once, TWICE[number])
        number -= len(TWICE)
        if not {c for c in text if c > "\x7f"} <= self._known[number]:
            return None
        return text.translate(self._tables[number])


_CIPHERS = None


def ciphers() -> Ciphers:
    global _CIPHERS
    if _CIPHERS is None:
        _CIPHERS = Ciphers()
    return _CIPHERS


def word_key(word: str) -> int:
    return xxhash.xxh32_intdigest(re.sub(r"\d", "0", word.lower().strip("""!"'()*,-./:;?[]"""))) % SKETCH


def segments(text: str) -> Iterator[list[str]]:
    """The tokens beyond ASCII of each sentence or line that has any."""
    for line in text.split("\n"):
        if line.isascii():
            continue
        part: list[str] = []
        for word in line.split(" "):
            if not word.isascii():
                part.append(word)
            if word[-1:] in (".", "!", "?", "…") and part:
                yield part
                part = []
        if part:
            yield part


class Language:
    """Scores of ciphers by letter bigrams and word counts."""

    def __init__(self, bigrams: np.ndarray, words: np.ndarray, known: tuple[list[str], np.ndarray] | None = None):
        """known: the gains of some words, so that they need not be found again."""
        self.logs, self.words = bigrams, words
        self.known: dict[str, np.ndarray] = dict(zip(*known)) if known else {}
        self.runs: dict[str, np.ndarray] = {}
        # words that some cipher improves
        self.better: set[str] = {w for w, gain in zip(known[0], known[1].max(axis=1, initial=0)) if gain > 0} if known else set()

    def gains(self, word: str) -> np.ndarray:
        """For each cipher, the gain in log-probability when the word is undone."""
        if word not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = found = self._gains(word)
            if found.max() > 0:
                self.better.add(word)
        return self.known[word]

    def _run_gains(self, run: str) -> np.ndarray:
        """Of a run of characters beyond ASCII with the one before and the one behind it, by bigrams alone; -inf where it can't be undone."""
        if run in self.runs:
            return self.runs[run]
        if len(self.runs) > 100_000:
            self.runs.clear()
        c = ciphers()
        out = np.full(len(c.names), -np.inf, np.float32)
        inner = run[1:-1]
        undone = {}
        for k in range(c.first_single):
            # letters beyond ASCII have two bytes and more, so in a single-byte page each is two characters or more
            if len(inner) > 1 or c.multi[k]:
                u = c.undo(k, inner)
                if u is not None:
                    undone[k] = run[0] + u + run[-1]
        x = letter_classes(run)
        own = self.logs[x[:-1], x[1:]].sum()
        for k, u in undone.items():
            y = letter_classes(u)
            out[k] = self.logs[y[:-1], y[1:]].sum() - own
        x = np.frombuffer(run.encode("utf-32-le", "surrogatepass"), np.uint32)
        x = c.classes[:, np.minimum(x, 0xFFFF)]
        x[:, 0], x[:, -1] = letter_classes(run[0])[0], letter_classes(run[-1])[0]
        some = np.flatnonzero((x >= 0).all(axis=1))
        x = x[some]
        out[some + c.first_single] = self.logs[x[:, :-1], x[:, 1:]].sum(axis=1) - own
        self.runs[run] = out
        return out

    def _gains(self, word: str) -> np.ndarray:
        # ASCII stays as it is under every cipher, so only the runs between change the bigrams
        padded = f" {word} "
        out = sum(self._run_gains(padded[m.start() - 1 : m.end() + 1]) for m in _RUN.finditer(padded))
        c = ciphers()
        # how often the words occur matters where the letters leave it open
        open_ = np.flatnonzero(out > -6)
        if len(open_):
            texts = [c.undo(k, word) or word for k in open_.tolist()]
            key = {w: word_key(w) for w in {word, *texts}}
            count = np.log(self.words[[key[word], *[key[w] for w in texts]]] + 0.5)
            same = np.array([w == word for w in texts])
            out[open_] += np.clip(count[1:] - count[0], -6, 6)
            out[open_[same]] = 0
        return np.maximum(out, BAD)

    def oddest(self, word: str) -> float:
        """Log-probability of the least likely bigram that has a character beyond ASCII."""
        padded = f" {word} "
        x = letter_classes(padded)
        beyond = np.array([c > "\x7f" for c in padded])
        return float(self.logs[x[:-1], x[1:]][beyond[:-1] | beyond[1:]].min(initial=0))

    def text_scores(self, text: str) -> np.ndarray:
        """For each cipher the summed gain over the sentences it improves; a word counts once a text."""
        total = np.zeros(len(ciphers().names), np.float32)
        seen: set[str] = set()
        for part in segments(text):
            new = set(part) - seen
            if new:
                seen |= new
                rows = [self.gains(w) for w in new]
                if any(w in self.better for w in new):
                    total += np.maximum(sum(rows), 0)
        return total

    def restore(self, text: str, likely: list[int]) -> str:
        """The text with every sentence undone by the likely cipher that gains most, where one gains."""
        c = ciphers()
        lines = []
        for line in text.split("\n"):
            if line.isascii():
                lines.append(line)
                continue
            words, start = line.split(" "), 0
            for i, word in enumerate(words):
                if word[-1:] not in (".", "!", "?", "…") and i < len(words) - 1:
                    continue
                odd = [w for w in words[start : i + 1] if not w.isascii()]
                if odd:
                    total = sum(self.gains(w) for w in odd)
                    best = max(likely, key=lambda k: total[k])
                    if total[best] > 2:
                        words[start : i + 1] = [w if w.isascii() else c.undo(best, w) or w for w in words[start : i + 1]]
                start = i + 1
            lines.append(" ".join(words))
        return "\n".join(lines)


def odd_tokens(text: Column) -> Column:
    """The tokens of a text, between blanks and line breaks, that have a character beyond ASCII."""
    return F.filter(F.split(text, "[ \n]"), lambda w: w.rlike(r"[^\x00-\x7F]"))


def letter_counts(texts: DataFrame, tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the bigrams of letter classes, over the column `text`, and of the words beyond ASCII (hashed), of tokens (token, n)."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            column = batch.column("text").to_pylist()
            for i in range(0, len(column), 512):
                x = letter_classes(" \n ".join(column[i : i + 512]))
                out += np.bincount(x[:-1] * CLASSES + x[1:], minlength=len(out))
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["k", "n"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([word_key(w) for w in batch.column("token").to_pylist()], pa.int64()), batch.column("n")], ["k", "n"])

    out = []
    for df, size in ((texts.select("text").mapInArrow(pairs, "k bigint, n bigint"), CLASSES * CLASSES), (tokens.mapInArrow(words, "k bigint, n bigint"), SKETCH)):
        found, count = df.groupBy("k").agg(F.sum("n").alias("n")).toArrow(), np.zeros(size)  # CLASSES^2 and SKETCH rows at most
        count[found["k"].to_numpy()] = found["n"].to_numpy()
        out.append(count)
    return out[0], out[1]


def language_of(pairs: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of letter bigrams, and the word counts."""
    pairs = np.maximum(pairs, 0).reshape(CLASSES, CLASSES)
    alone = pairs.sum(axis=0) + 0.01
    alone /= alone.sum()
    return np.log((pairs + 5 * alone) / (pairs.sum(axis=1, keepdims=True) + 5)).astype(np.float32), np.maximum(words, 0).astype(np.float32)


def learned_table(chars: np.ndarray, before: np.ndarray, after: np.ndarray, n: np.ndarray, logs: np.ndarray, letters: np.ndarray, prior: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(number of the likeliest of `letters`, its probability) for each of `chars`, by expectation-maximization.

    before, after and n are the bigrams there are, as characters and counts; chars are those of them whose letter is unknown, all others stand for
    themselves. Each round expects the letters of a character from the bigrams with its neighbours, in place of which, where they are unknown too, stand
    the letters expected of them; all counts together weigh as one in the first round and a quarter more in each, so that no early guess is final. A
    letter stands as one character, so what is expected of it is shared out to no more than that. prior: log-probability of each letter for each
    character.
    """
    place = {int(c): i for i, c in enumerate(chars)}
    a, b = (np.array([place.get(int(c), -1) for c in side]) for side in (before, after))
    own_a, own_b = (letter_classes("".join(map(chr, side))) for side in (before, after))
    given = np.zeros((len(chars), len(letters)))
    known = (a < 0) & (b >= 0)
    np.add.at(given, b[known], n[known, None] * logs[own_a[known]][:, letters])
    known = (a >= 0) & (b < 0)
    np.add.at(given, a[known], n[known, None] * logs[:, own_b[known]].T[:, letters])
    both = np.flatnonzero((a >= 0) & (b >= 0))
    inner = logs[np.ix_(letters, letters)].astype(float)
    total = np.bincount(a[a >= 0], n[a >= 0], len(chars)) + np.bincount(b[b >= 0], n[b >= 0], len(chars))
    q = np.exp(prior - prior.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    for r in range(rounds):
        s = given.copy()
        np.add.at(s, b[both], n[both, None] * (q[a[both]] @ inner))
        np.add.at(s, a[both], n[both, None] * (q[b[both]] @ inner.T))
        s = s * np.minimum(1, 1.25**r / total)[:, None] + prior
        q = np.exp(s - s.max(axis=1, keepdims=True))
        for _ in range(5):
            q /= q.sum(axis=1, keepdims=True)
            q /= np.maximum(1, q.sum(axis=0))
    return q.argmax(axis=1), q.max(axis=1)


def free_tables(left: DataFrame, logs: np.ndarray, alone: np.ndarray, least: int) -> DataFrame:
    """(source, char, letter): each source's learned table, of left (source, token, n), tokens with rare bigrams.

    A character takes part that stands in a rare bigram `least` times or more in a source; which letter it is, and whether it is one, shows when words
    come out. A group is the distinct bigrams of
    one source, so its size is bounded by the characters there are."""
    letters = np.array([c for c in range(128, 0x600) if chr(c).isalpha() and chr(c).lower() == chr(c) and alone[c] > 1e-7])
    schema = "source string, char string, letter string"
    if not len(letters):
        return left.sparkSession.createDataFrame([], schema)
    c = ciphers()
    text = F.concat(F.lit(" "), F.col("token"), F.lit(" "))
    pairs = left.select("source", "n", text.alias("t")).select("source", "n", "t", F.explode(F.sequence(F.lit(1), F.length("t") - 1)).alias("i"))
    pairs = pairs.select("source", F.substring("t", F.col("i"), F.lit(1)).alias("a"), F.substring("t", F.col("i") + 1, F.lit(1)).alias("b"), "n").filter(F.concat("a", "b").rlike(r"[^\x00-\x7F]"))

    def learn(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        a, b = (np.array([ord(x) for x in rows[k].to_pylist()], np.int64) for k in ("a", "b"))
        n = rows["n"].to_numpy().astype(float)
        strange = logs[letter_classes("".join(map(chr, a))), letter_classes("".join(map(chr, b)))] < ODD
        often: dict[int, float] = {}
        for x, y, m, odd in zip(a.tolist(), b.tolist(), n.tolist(), strange.tolist()):
            for z in (x, y):
                if odd and z > 127:
                    often[z] = often.get(z, 0) + m
        chars = np.array(sorted(z for z, m in often.items() if m >= least), np.int64)
        if not len(chars):
            return pa.table({"source": pa.array([], pa.string()), "char": pa.array([], pa.string()), "letter": pa.array([], pa.string())})
        prior = np.log(np.tile(alone[letters] / alone[letters].sum(), (len(chars), 1)) + 1e-4)
        number = {int(x): i for i, x in enumerate(letters)}
        for i, z in enumerate(chars.tolist()):
            for k in np.unique(c.classes[:, z] if z < 0x10000 else np.zeros(0, int)).tolist():
                if k in number:
                    prior[i, number[k]] += 1.0
        best, p = learned_table(chars, a, b, n, logs, letters, prior)
        sure = [(chr(z), chr(letters[k])) for z, k, q in zip(chars.tolist(), best, p) if q > 0.9 and letters[k] != letter_classes(chr(z))[0]]
        return pa.table({"source": pa.array([key[0].as_py()] * len(sure), pa.string()), "char": pa.array([x for x, _ in sure], pa.string()), "letter": pa.array([y.upper() if x.isupper() else y for x, y in sure], pa.string())})

    return pairs.groupBy("source", "a", "b").agg(F.sum("n").alias("n")).groupBy("source").applyInArrow(learn, schema)


def source_posteriors(scored: DataFrame, sizes: DataFrame, prior: float = 1e-3, strength: float = 200.0, rounds: int = 3) -> DataFrame:
    """(item_id, cipher, p): the probability of each cipher that scores, of scored (item_id, source, cipher, score) and sizes (source, n). The
    frequency of a cipher in a source is learned from its texts and drawn towards that in all sources with the weight of `strength` texts."""
    whole = sizes.agg(F.sum("n").alias("all"))
    current = scored.withColumn("weight", F.lit(prior))
    for k in range(rounds):
        e = F.exp(F.least(F.col("score"), F.lit(60.0)) + F.log("weight"))
        mass = current.withColumn("e", e).groupBy("item_id").agg(F.sum("e").alias("mass"))
        known = current.withColumn("e", e).join(mass, "item_id").select("item_id", "source", "cipher", "score", (F.col("e") / (1 + F.col("mass"))).alias("p"))
        if k == rounds - 1:
            return known.select("item_id", "cipher", "p")
        overall = known.groupBy("cipher").agg(F.sum("p").alias("any")).crossJoin(F.broadcast(whole)).select("cipher", ((F.col("any") + 0.5) / (F.col("all") + 1000)).alias("general"))
        own = known.groupBy("source", "cipher").agg(F.sum("p").alias("own")).join(sizes, "source").join(F.broadcast(overall), "cipher")  # one row a cipher
        weights = own.select("source", "cipher", ((F.col("own") + strength * F.col("general")) / (F.col("n") + strength)).alias("weight"))
        current = saved(known.drop("p").join(weights, ["source", "cipher"]), "weights")
    return current


def garbled_texts(df: DataFrame, id_col: str, text_col: str, source_col: str, rounds: int = 2, restore: bool = True, least: float = 0.5, least_odd: int = 8, max_known: int = 20_000, max_broadcast: int = 1_000_000) -> DataFrame:
    """(item_id, ciphers, p_garbled, restored, complete) for every text whose probability of being garbled exceeds `least`.

    ciphers: names of the likely ciphers, the likeliest first, and FREE where the source's own table applies; that is learned for characters that stand
    `least_odd` times in rare bigrams of a source, and a text with two words that it turns into known ones is a
    case. The gains of the max_known most frequent tokens are broadcast, as they would be found anew in every task. restored: the text with these undone, null where nothing could be; complete: whether
    no character remains lost. A text with control characters from U+0080 to U+009F (but U+0085) or the replacement character U+FFFD is always a case, though what
    the latter replaced can't be regained. Null, empty
    and plain ASCII texts are never a case. Spellings of a source that differ in case, outer blanks or `_` for `-` are one, a null source is one of
    its own. An id with several texts comes out once for each garbled one; identical rows count once. With restore=False the last pass is left out
    and restored is null. Other columns are ignored.
    """
    spark = df.sparkSession
    source = F.coalesce(source_key(F.col(source_col)), F.lit(""))
    every = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), source.alias("source")).filter("text <> ''")
    # a text is told by id and hash, so an id with several texts does no harm
    given = every.filter(F.col("text").rlike(r"[^\x00-\x7F]")).select(F.struct(F.col("id"), F.xxhash64("text").alias("h")).alias("item_id"), "text", "source")
    kind = given.schema["item_id"].dataType.simpleString()
    sizes = saved(given.groupBy("source").agg(F.count("*").alias("n")), "sizes")
    held = saved(given.select("item_id", "source", odd_tokens(F.col("text")).alias("tokens")), "held")

    def counted(rows: DataFrame, *by: str) -> DataFrame:
        return rows.select(*by, F.explode("tokens").alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))

    tokens = saved(counted(held), "tokens")

    def few(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= max_broadcast else rows

    width = len(ciphers().names)
    pairs, words = letter_counts(every, tokens)
    for k in range(rounds):
        learned = language_of(pairs, words)
        language = spark.sparkContext.broadcast(learned)

        def improve(batches: Iterator[pa.RecordBatch], language=language) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            lang = Language(*language.value)
            for batch in batches:
                names = batch.column("token").to_pylist()
                gains = np.array([lang.gains(w) for w in names], np.float32).reshape(-1, width)
                lists = pa.ListArray.from_arrays(np.arange(0, width * (len(names) + 1), width, dtype=np.int32), pa.array(gains.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.select(["token", "n"]).columns, pa.array(gains.max(axis=1, initial=BAD).astype(float)), pa.array([lang.oddest(w) for w in names], pa.float64()), lists], ["token", "n", "best", "oddest", "gains"])

        # few bytes but much work, so all tasks share it
        shared = tokens.repartition(2 * spark.sparkContext.defaultParallelism, "token")
        judged = saved(shared.mapInArrow(improve, "token string, n bigint, best double, oddest double, gains array<float>"), "judged")
        # the most frequent tokens need not be judged again in every task
        frequent = judged.orderBy(F.desc("n"), "token").limit(max_known).select("token", "gains").toArrow()
        cache = spark.sparkContext.broadcast((frequent["token"].to_pylist(), frequent["gains"].combine_chunks().flatten().to_numpy().reshape(-1, width)))

        def score(batches: Iterator[pa.RecordBatch], language=language, cache=cache) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            lang = Language(*language.value, cache.value)
            for batch in batches:
                row, cipher, value = [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    s = lang.text_scores(text)
                    top = np.flatnonzero(s > 1)
                    row += [i] * len(top)
                    cipher += top.tolist()
                    value += s[top].tolist()
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(at), batch.column("source").take(at), pa.array(cipher, pa.int32()), pa.array(value, pa.float64())], ["item_id", "source", "cipher", "score"])

        distinct = held.select("item_id", F.explode(F.array_distinct("tokens")).alias("token"))
        may = few(saved(distinct.join(few(judged.filter("best > 0").select("token")), "token", "left_semi").select("item_id").distinct(), "candidates"))
        candidates = given.join(may, "item_id", "left_semi")
        scored = saved(candidates.mapInArrow(score, f"item_id {kind}, source string, cipher int, score double").distinct(), "scored")
        likely = source_posteriors(scored, sizes).filter("p > 0.01").groupBy("item_id").agg(F.sum("p").alias("p_garbled"), F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("q"), "cipher"))).alias("of"))
        likely = saved(likely.filter(F.col("p_garbled") > least), "likely")
        if k < rounds - 1:
            gone = few(likely.select("item_id"))
            wrong = letter_counts(given.join(gone, "item_id", "left_semi"), counted(held.join(gone, "item_id", "left_semi")))
            pairs, words = pairs - wrong[0], words - wrong[1]
            # all that was made with them is saved
            language.destroy()
            cache.destroy()

    # what is left: tokens with rare bigrams in the texts that no known cipher explains
    odd = few(judged.filter(F.col("oddest") < ODD).select("token"))
    rest = held.join(few(likely.select("item_id")), "item_id", "left_anti")
    left = saved(counted(rest, "source").join(odd, "token", "left_semi"), "left")
    logs, counts = learned
    alone = np.maximum(pairs, 0).reshape(CLASSES, CLASSES).sum(axis=0)
    tables = free_tables(left, logs, alone / max(alone.sum(), 1), least_odd)
    table = saved(tables.groupBy("source").agg(F.concat_ws("", F.collect_list("char")).alias("chars"), F.concat_ws("", F.collect_list("letter")).alias("letters")), "tables")

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = [i for i, (w, x) in enumerate(zip(batch.column("token").to_pylist(), batch.column("written").to_pylist())) if w != x and counts[word_key(x)] > max(1.0, 2 * counts[word_key(w)])]
            yield batch.take(pa.array(row, pa.int64()))

    # two different words that turn into words known from elsewhere make a case
    every_token = counted(rest.join(few(table), "source"), "source", "chars", "letters")
    written = every_token.select("source", "token", F.expr("translate(token, chars, letters)").alias("written")).mapInArrow(known, "source string, token string, written string")
    written = saved(written, "written")
    by_table = rest.select("item_id", "source", F.explode(F.array_distinct("tokens")).alias("token")).join(few(written), ["source", "token"]).groupBy("item_id").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_set(F.struct("token", "written"))).alias("words")).filter("n >= 2").select("item_id", "words")
    # control characters beyond ASCII (but for the line break U+0085) are never written; U+FFFD stands for what no page could read
    lost = given.filter(F.col("text").rlike("[\\x80-\\x84\\x86-\\x9F\\uFFFD]")).select("item_id").distinct()
    found = likely.join(lost.withColumn("lost", F.lit(True)), "item_id", "full_outer").join(by_table, "item_id", "full_outer")
    names = F.array(*[F.lit(n) for n in ciphers().names])
    numbers = F.coalesce(F.transform("of", lambda x: x["cipher"]), F.array().cast("array<int>"))
    sure = F.when(F.col("lost") | F.col("words").isNotNull(), 1.0)
    found = found.select("item_id", F.round(F.coalesce(sure, "p_garbled"), 6).alias("p_garbled"), numbers.alias("numbers"), "words")
    own = F.when(F.col("words").isNotNull(), F.array(F.lit(FREE))).otherwise(F.array().cast("array<string>"))
    found = saved(found.withColumn("ciphers", F.concat(F.transform("numbers", lambda k: F.get(names, k)), own)), "found")
    if not restore:
        return found.select(F.col("item_id.id").alias("item_id"), "ciphers", "p_garbled", F.lit(None).cast("string").alias("restored"), F.lit(None).cast("boolean").alias("complete"))
    affected = given.join(few(found), "item_id").select("item_id", "text", "numbers", "words", "ciphers", "p_garbled").dropDuplicates(["item_id"])

    def undo(batches: Iterator[pa.RecordBatch], language=language, cache=cache) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        lang = Language(*language.value, cache.value)
        for batch in batches:
            done = []
            for text, numbers, own in zip(*(batch.column(c).to_pylist() for c in ("text", "numbers", "words"))):
                new = lang.restore(lang.restore(text, numbers), numbers) if numbers else text  # some went wrong twice
                for token, word in own or []:
                    new = re.sub(rf"(?<![^ \n]){re.escape(token)}(?![^ \n])", lambda _, word=word: word, new)
                done.append(new if numbers or own else None)
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("ciphers"), batch.column("p_garbled"), pa.array(done, pa.string())], ["item_id", "ciphers", "p_garbled", "restored"])

    done = affected.mapInArrow(undo, f"item_id {kind}, ciphers array<string>, p_garbled double, restored string")
    return done.select(F.col("item_id.id").alias("item_id"), "ciphers", "p_garbled", "restored", F.coalesce(~F.col("restored").contains(LOST), F.lit(False)).alias("complete"))
