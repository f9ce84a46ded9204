"""BPE encoding and decoding through a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton whose arcs are tokens and whose state
is the token read last: a path spells a word's tokens exactly if it is the word's tokenization. Each
merge (a, b) is a gadget: it takes the arc b away from the state of a and adds the arc ab wherever the
arc a was, to a new state that keeps the arcs of the state of b. Stored that way, a state is its merge
and a pointer to b's state, an arc label is its merge and a pointer to a, and the whole automaton takes
two pointers and a rank a token; transitions asked for are kept in a table.

Every prefix of a word has one path as well, so encoding keeps a single state for each position: the arc
that ends there and may follow the state where it begins. Decoding emits the labels of the arcs.

Words are found as the vocabulary's own rules say: NFC, white space to one blank, lower case, split.

Defined results: a null or empty text has no ids and decodes to the empty text; the two special tokens
are recognised in the raw text; repeated rows give equal results; an empty table gives an empty result;
other columns pass through, and ``ids``, ``n_tokens`` and ``decoded`` replace columns of those names.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, normalizers, pre_tokenizers

from canopyql.llm.kept import kept
from canopyql.session import table

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
#: Words and transitions that a worker keeps; beyond it the older half is forgotten and made again.
KEPT_WORDS, KEPT_ARCS = 300_000, 1_000_000

#: White space as the vocabulary's splitting rule understands it (Unicode White_Space).
_BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w ]|_)+")
#: Anything but ASCII, Latin letters and common punctuation.
_BEYOND = re.compile("[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027]")
_SPLIT_FULL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    letters = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Automaton:
    """Tokenization automaton of a merge list; see the module's text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        n = max(vocab.values()) + 1
        self.vocab = vocab
        #: A token's halves in the derivation that its own text takes; -1 for single letters.
        self.left, self.right = [-1] * n, [-1] * n
        #: The rank of a token's merge (-1 for a letter), and of each merge.
        self.born = [-1] * n
        self.rank: dict[tuple[int, int], int] = {}
        self.arcs: dict[str, int] = {}
        self.table: dict[int, bool] = {}
        alphabet = byte_letters()
        for c in alphabet:
            for s in (c, c + END):
                self.arcs[s] = vocab[s]
        usable = set(self.arcs.values())
        for m, (x, y) in enumerate(merges):
            a, b, made = vocab[x], vocab[y], vocab[x + y]
            # the gadget has arcs to work on only where the arc b still follows the arc a
            if a in usable and b in usable and made not in usable and self._follows(a, b):
                self.left[made], self.right[made], self.born[made] = a, b, m
                self.arcs[x + y] = made
                usable.add(made)
            self.rank.setdefault((a, b), m)
        self.longest = max(len(s.removesuffix(END)) for s in self.arcs)

    def _follows(self, x: int, y: int) -> bool:
        """Whether the arc y leaves the state of x after the gadgets so far.

        Undoes both tokens side by side: at any time the letters next to the seam belong to one token on
        each side, and a gadget for that pair cut the arc if it came before either token grew on (on the
        same gadget, the pair further left is merged first).
        """
        grown_x = grown_y = sys.maxsize
        while True:
            m = self.rank.get((x, y), sys.maxsize)
            if m < grown_x and m <= grown_y and m != sys.maxsize:
                return False
            born_x, born_y = self.born[x], self.born[y]
            if born_x < 0 and born_y < 0:
                return True
            if born_x >= born_y:
                x, grown_x = self.right[x], born_x
                if born_x == born_y:
                    y, grown_y = self.left[y], born_y
            else:
                y, grown_y = self.left[y], born_y

    def follows(self, x: int, y: int) -> bool:
        key = x << 20 | y
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= KEPT_ARCS:
                self.table.clear()
            found = self.table[key] = self._follows(x, y)
        return found

    def encode(self, word: str) -> list[int]:
        """The ids of a word, given in byte letters and not empty."""
        arcs, follows, longest = self.arcs, self.follows, self.longest
        if (whole := arcs.get(word + END)) is not None:
            return [whole]
        n = len(word)
        state, start = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            end = END if i == n else ""
            for j in range(max(0, i - longest), i):
                t = arcs.get(word[j:i] + end)
                if t is not None and (j == 0 or follows(state[j], t)):
                    state[i], start[i] = t, j
                    break
        ids, i = [], n
        while i:
            ids.append(state[i])
            i = start[i]
        return ids[::-1]


class Codec:
    """Texts to ids and back, with the words met lately kept."""

    def __init__(self, spec: dict):
        self.automaton = Automaton(spec["vocab"], spec["merges"])
        self.special = {s: i for s, i in spec["special"]}
        self.labels = {i: s for s, i in spec["vocab"].items()} | {i: s for s, i in spec["special"]}
        self.letters = byte_letters()
        self.nfc, self.lower, self.full = normalizers.NFC(), normalizers.Lowercase(), pre_tokenizers.Split(Regex(_SPLIT_FULL), "removed", invert=True)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
    def _word(self, word: str) -> bytes:
        """A word's ids as 32-bit numbers."""
        got = self.old.pop(word, None)
        if got is None:
            letters = self.letters
            got = np.array(self.automaton.encode("".join([letters[b] for b in word.encode()])), dtype=np.int32).tobytes()
        if len(self.young) >= KEPT_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = got
        return got

    def _plain(self, text: str) -> bytes:
        if _BEYOND.search(text):
            # other scripts: the library's own tables for normal forms and case, and full classes of letters and numbers
            text = self.lower.normalize_str(_BLANK.sub(" ", self.nfc.normalize_str(text)))
            words = [w for w, _ in self.full.pre_tokenize_str(text)]
        else:
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
            words = _SPLIT.findall(_BLANK.sub(" ", text).lower())
        young, word = self.young.get, self._word
        return b"".join([young(w) or word(w) for w in words])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text and self.at_special:
            parts = self.at_special.split(text)
            return b"".join(np.int32(self.special[p]).tobytes() if p in self.special else self._plain(p) for p in parts if p)
        return self._plain(text)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


def specification(path: str) -> dict:
    """What the automaton needs of a tokenizer file; read on the driver, bounded by that file."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    return {"vocab": raw["model"]["vocab"], "merges": [tuple(m) for m in raw["model"]["merges"]], "special": [(t["content"], t["id"]) for t in raw["added_tokens"]]}


def codec_for(key: str, spec: Callable[[], dict]) -> Codec:
    """This process's codec for a file, compiled once."""
    return kept(key, lambda: Codec(spec()))


def encode_decode(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """docs with ids (array<int>), n_tokens (long) and decoded (string); the text column is dropped."""
    path = path or public_tokenizers.path(VOCABULARY)
    spec = docs.sparkSession.sparkContext.broadcast(specification(path))
    own = ("ids", "n_tokens", "decoded")
    kept = [c for c in docs.columns if c not in own and c != column]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(column).alias("_text"))
    fields = [f for f in rows.schema.fields if f.name != "_text"]
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_for(path, lambda: spec.value)
        for batch in batches:
            # a few documents at a time, so that memory follows the longest text
            texts = batch.column(batch.num_columns - 1)
            for at, size in _pieces(texts):
                part = batch.slice(at, size)
                ids = [codec.encode(t) for t in texts.slice(at, size).to_pylist()]
                flat = np.frombuffer(b"".join(ids), dtype=np.int32)
                ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
                decoded = [codec.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                columns = [*part.columns[:-1], lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _pieces(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of texts with about most bytes, at least one text each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for i, s in enumerate(sizes):
        if i > first and total + s > most:
            yield first, i - first
            first, total = i, 0
        total += int(s)
    if len(sizes) > first:
        yield first, len(sizes) - first


def with_digests(encoded: DataFrame) -> DataFrame:
    """Adds ids_sha256 and decoded_sha256."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.withColumns({"ids_sha256": F.sha2(ids, 256), "decoded_sha256": F.sha2("decoded", 256)})


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    out = with_digests(encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
