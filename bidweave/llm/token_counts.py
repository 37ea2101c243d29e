"""Exact token counts at every prefix of a text, by dynamic programming.

The tokens of a byte-pair encoding have the property that a sequence of tokens is the
encoding of its text if and only if each adjacent pair is the encoding of its own text. So the
last token of a prefix is the one vocabulary entry that ends there and agrees with the
last token of the prefix before it, and

    count(prefix) = count(prefix without its last token) + 1.

Each state (last token's length and count) is kept by prefix, so words share the work
of their common beginnings and a truncation or budget question is a look-up in the counts
at all prefixes of a text: no text is encoded again. White space never occurs inside a piece after its first characters, so a text's
count is the sum over its blank-led words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm.bpe_core import SHIFT, merge
from bidweave.llm.common import prepare, sliced

#: How the vocabulary writes a blank.
BLANK = "▁"
SEGMENT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
#: Up to this length a word's prefixes are kept; longer ones are counted in an array of their own.
LONG = 64


class PrefixCounter(dict):
    """Counts by segment (a word with the blanks before it, blanks alone, or a line feed)."""

    #: Entries kept of segments and of prefixes; beyond that a store is emptied, which costs time only.
    KEPT = 300_000

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        pieces = {model.id_to_piece(i): model.get_score(i) for i in normal}
        self.runs = {len(p) for p in pieces if set(p) == {BLANK}}
        ranked = sorted((p for p in pieces if len(p) == 1 or set(p) != {BLANK}), key=lambda p: -pieces[p])
        self.number = {p: i for i, p in enumerate(ranked)}
        #: Strange characters get numbers of their own, which no pair contains.
        self.strange = len(ranked)
        self.pairs = {self.number[p[:i]] << SHIFT | self.number[p[i:]]: r for p, r in self.number.items() for i in range(1, len(p)) if p[:i] in self.number and p[i:] in self.number}
        self.longest = max(map(len, self.number))
        self.prefixes: dict[str, int] = {}
        self.agreed: dict[tuple[str, str], bool] = {}
        self.small_runs: list[int] | None = None
        self.longest_run = 1

    def _symbols(self, text: str) -> list[int]:
        return [self.number.get(c, self.strange) for c in text]

    def agree(self, left: str, right: str) -> bool:
        """Whether the two tokens, next to each other, are the encoding of their text."""
        key = (left, right)
        found = self.agreed.get(key)
        if found is None:
            if len(self.agreed) > 2 * self.KEPT:
                self.agreed.clear()
            own = [self.number.get(t, self.strange) for t in key if t]
            found = self.agreed[key] = merge(self._symbols(left + right), self.pairs.get) == own
        return found

    def _extend(self, text: str, states: list[int], kept: dict[str, int] | None = None) -> list[int]:
        """Adds the states of the prefixes of text that are longer than those that states has."""
        number, agreed, longest = self.number, self.agreed, self.longest
        for end in range(len(states), len(text) + 1):
            for size in range(1, min(end, longest) + 1):
                begin = end - size
                token = text[begin:end]
                if size > 1 and token not in number:
                    continue
                key = (text[begin - (states[begin] & 255) : begin], token)
                if agreed[key] if key in agreed else self.agree(*key):
                    break
            else:
                raise AssertionError(f"no token ends {text[:end]!r}")
            state = (states[begin] >> 8) + (1 if size > 1 or token in number else len(token.encode("utf-8"))) << 8 | size
            states.append(state)
            if kept is not None:
                kept[text[:end]] = state
        return states

    def word(self, text: str) -> int:
        """Count and last token's length of a word with one blank before it at most, as count << 8 | length."""
        kept = self.prefixes
        if (found := kept.get(text)) is not None:
            return found
        if len(text) > LONG:
            return self._states(text)[-1]
        if len(kept) > 2 * self.KEPT:
            kept.clear()
        known = len(text) - 1
        while known and text[:known] not in kept:
            known -= 1
        # The prefixes of a kept prefix are kept too: the store is only emptied as a whole.
        states = [0, *[kept[text[:i]] for i in range(1, known + 1)]]
        return self._extend(text, states, kept)[-1]

    def _states(self, text: str) -> list[int]:
        return self._extend(text, [0])

    def run(self, n: int) -> int:
        """Tokens of n blanks in a row; they merge last and from the left.

        The left one grows to the longest run and then stays, so counts repeat, one token more, after that length."""
        if self.small_runs is None:
            longest = max(self.runs, default=1)
            self.small_runs = [self._merged_run(i) for i in range(3 * longest + 1)]
            if any(self.small_runs[i] != self.small_runs[i - longest] + 1 for i in range(longest, 3 * longest + 1)):
                raise ValueError("runs of blanks do not repeat in this vocabulary")
            self.longest_run = longest
        whole, rest = divmod(n, self.longest_run)
        return whole + self.small_runs[rest]

    def _merged_run(self, n: int) -> int:
        own, i = [1] * n, 0
        while i + 1 < len(own):
            if own[i] + own[i + 1] in self.runs:
                own[i : i + 2] = [own[i] + own[i + 1]]
                i = 0
            else:
                i += 1
        return len(own)

    def __missing__(self, segment: str) -> int:
        if segment == "\n":
            count = 1
        else:
            word = segment.lstrip(BLANK)
            blanks = len(segment) - len(word)
            if not word:
                count = self.run(blanks)
            elif blanks < 2:
                count = self.word(segment) >> 8
            else:
                count = self.word(BLANK + word) >> 8
                joined = self.first_is_blank(BLANK + word)
                count += self.run(blanks) - 1 if joined else self.run(blanks - 1)
        if len(segment) <= LONG:
            if len(self) > self.KEPT:
                self.clear()
            self[segment] = count
        return count

    def first_is_blank(self, text: str) -> bool:
        """Whether the first token of a blank-led word is the blank alone."""
        states = self._states(text)
        end = len(text)
        while end > (size := states[end] & 255):
            end -= size
        return size == 1

    def prefix_counts(self, segment: str) -> list[int]:
        """Tokens of each prefix of a segment, the empty one first. One pass over the states."""
        if segment == "\n":
            return [0, 1]
        word = segment.lstrip(BLANK)
        blanks = len(segment) - len(word)
        out = [self.run(i) for i in range(blanks + 1)]
        if word:
            lead = min(blanks, 1)
            states = self._states(BLANK * lead + word)
            alone, joined = (self.run(blanks) - 1, self.run(blanks - 1)) if blanks > 1 else (0, 0)
            first = [0] * len(states)  # length of each prefix's first token
            for end in range(1, len(states)):
                begin = end - (states[end] & 255)
                first[end] = first[begin] if begin else end
            out += [(s >> 8) + (alone if f == 1 else joined) for s, f in zip(states[lead + 1 :], first[lead + 1 :])]
        return out

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        return SEGMENT.findall(BLANK + text.replace(" ", BLANK))

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.segments(text)))

    def all_prefixes(self, text: str) -> list[int]:
        """Tokens of every prefix of a text, by its number of characters, the empty one first."""
        out, used = [0], 0
        for segment in self.segments(text):
            counts = self.prefix_counts(segment)
            out += [used + c for c in counts[1:]]
            used = out[-1]
        # The blank that is put before a text is no character of it.
        return [0, *out[2:]]

    def fits(self, text: str, budget: int, segments: list[str] | None = None) -> int:
        """Characters of the longest prefix whose own encoding has ``budget`` tokens at most."""
        at = used = 0
        for segment in segments if segments is not None else self.segments(text):
            cost = self[segment]
            if used + cost > budget:  # within the segment the count of each prefix answers
                best = max(i for i, c in enumerate(self.prefix_counts(segment)) if used + c <= budget or not i)
                return max(0, at + best - 1)
            used += cost
            at += len(segment)
        return len(text)


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4096, model_path: str | None = None, keep_prefixes: bool = False) -> DataFrame:
    """Tokens of every whole text, and what of it fits a budget.

    Returns the id column, n_bytes (UTF-8), n_tokens, over_limit (more than ``budget``) and
    fit_chars (characters of the longest prefix whose own encoding stays within the budget); with ``keep_prefixes`` also
    ``prefix_tokens``, the count at every prefix (element n is that of the first n characters), from which
    ``tokens_at`` and ``longest_within`` answer any truncation and budget.
    Null counts as the empty text: 0 tokens. Repeated rows each give a row, an empty table
    gives none, other columns are left out. ``model_path`` is a path on the executors. Time is linear in a text's length.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(model_path or default_model())
        for batch in sliced(batches, 16 if keep_prefixes else 256):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            totals, fit, prefixes = [], [], []
            for text in texts:
                found = counts.segments(text)
                n = sum(map(counts.__getitem__, found))
                totals.append(n)
                fit.append(len(text) if n <= budget else counts.fits(text, budget, found))
                if keep_prefixes:
                    prefixes.append(pa.array(counts.all_prefixes(text), pa.int32()).to_numpy())
            columns = [batch.column(0), batch.column(2), pa.array(totals, pa.int64()), pa.array([n > budget for n in totals], pa.bool_()), pa.array(fit, pa.int64())]
            names = ["_key", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if keep_prefixes:
                columns.append(pa.array(prefixes, pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names)

    taken = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    schema = f"_key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint" + ", prefix_tokens array<int>" * keep_prefixes
    return taken.mapInArrow(run, schema).withColumnRenamed("_key", id_col)


def tokens_at(prefix_tokens: Column, n_chars: Column | int) -> Column:
    """Tokens of a text cut to ``n_chars`` characters (of the whole text beyond its end)."""
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.element_at(prefix_tokens, F.least(n + 1, F.size(prefix_tokens)).cast("int"))


def longest_within(prefix_tokens: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix of ``budget`` tokens at most."""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.transform(prefix_tokens, lambda c, i: F.when(c <= limit, i).otherwise(0)))
