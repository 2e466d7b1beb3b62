"""SentencePiece encoding and decoding of merge-type models through a prefix table.

The encoding of a word's every prefix ends in one token only, so a table of last tokens is all
there is to know. It is filled from left to right: an automaton over all pieces gives the
pieces that end at a position; the right one is that which fits behind the last token of the
prefix before it, i.e. the two side by side are the model's own encoding of their joint text.
Ids are then read from the end of the word backwards.

Whether two tokens fit is decided by undoing merges: each token remembers the two parts its last
merge joined; going down from both sides of the seam, the pair fits if at no point would a merge
across the seam have come first. Characters outside the vocabulary are symbols of their own that
never merge and become byte tokens.

No piece continues from another character into a space mark, so texts are cut into words there
and the words' ids are joined; a bounded memory keeps the words of a task.

Defined results: null and empty texts have no ids and decode to the empty text; ids of rows may
be null or repeated, each row is worked on alone; an empty table gives no rows; further columns
don't take part.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame

from quillon.llm.shared import row_by_row

SPACE = "▁"
# A worker remembers at most twice so many.
KNOWN_WORDS = 350_000
WORD_CHARS = 200
PAIRS = 1_000_000
# A run of space marks opens a word; marks at the very end are a word of their own.
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, model_file: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.text: list[str] = [model.id_to_piece(i) for i in range(size)]
        self.byte_value = {
            i: int(self.text[i][3:5], 16) for i in range(size) if model.is_byte(i)
        }
        self.byte_id = {value: i for i, value in self.byte_value.items()}
        self.silent = {i for i in range(size) if model.is_control(i) or model.is_unknown(i)}
        plain = [
            i
            for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        if any(SPACE in self.text[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece runs across a space mark; words can't be cut there")
        self.score = {self.text[i]: model.get_score(i) for i in plain}
        self.id_of = {self.text[i]: i for i in plain}
        # Words met lately, and those met before them: a frequent word is never forgotten.
        self.known: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.fitting: dict[tuple[str, str], bool] = {}
        self._prepare()

    def _prepare(self) -> None:
        """For each piece that encodes to itself: the parts of its last merge.

        Pieces that the model never makes from their own text are left out of the automaton.
        """
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            parts = self._merged(piece)
            if parts is not False:
                self.parts[piece] = parts
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def _merged(self, piece: str) -> tuple[str, str] | None | bool:
        """The parts joined last when ``piece`` is merged from characters; False if it isn't."""
        if len(piece) == 1:
            return None
        symbols = self._merge_all(piece, watch=True)
        return symbols if isinstance(symbols, tuple) else False

    def _merge_all(self, text: str, watch: bool = False) -> list[str] | tuple[str, str]:
        """Plain merging, best score first, leftmost among equals; for single pieces."""
        symbols: list[str | None] = list(text)
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        score = self.score
        queue = []
        for at in range(len(symbols) - 1):
            found = score.get(symbols[at] + symbols[at + 1])
            if found is not None:
                queue.append((-found, at, symbols[at] + symbols[at + 1]))
        heapq.heapify(queue)
        last = None
        while queue:
            _, at, joined = heapq.heappop(queue)
            right = after[at]
            if symbols[at] is None or right < 0 or symbols[at] + symbols[right] != joined:
                continue
            last = (symbols[at], symbols[right])
            symbols[at], symbols[right] = joined, None
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0:
                    pair = symbols[left] + symbols[after[left]]
                    if pair in score:
                        heapq.heappush(queue, (-score[pair], left, pair))
        whole = [s for s in symbols if s is not None]
        return last if watch and len(whole) == 1 else whole

    def fits(self, left: str, right: str) -> bool:
        """Are ``left`` and ``right`` the model's encoding of their joint text?

        Both are merges known to the model, so only a merge across the seam could spoil them.
        Merging both is followed backwards: the part at the seam with the later merge is taken
        apart first. A merge across the seam is made if it beats that later merge.
        """
        key = (left, right)
        found = self.fitting.get(key)
        if found is not None:
            return found
        score, parts = self.score, self.parts
        a, b = left, right
        # The score that a merge across the seam must beat to be made, none at first: the two
        # stand side by side at the end, when any possible merge would be made.
        limit: tuple[float, int] = (float("-inf"), 0)
        answer = True
        while True:
            across = score.get(a + b)
            if across is not None and self._first(across, limit):
                answer = False
                break
            split_a, split_b = parts.get(a), parts.get(b)
            if split_a is None and split_b is None:
                break
            joined_a = score[a] if split_a else float("inf")
            joined_b = score[b] if split_b else float("inf")
            # Later means a lower score; at equal scores the right one is merged later.
            if split_b and (not split_a or joined_b <= joined_a):
                limit, b = (joined_b, 1), split_b[0]
            else:
                limit, a = (joined_a, 0), split_a[1]
        if len(self.fitting) >= PAIRS:
            self.fitting.clear()
        self.fitting[key] = answer
        return answer

    @staticmethod
    def _first(across: float, limit: tuple[float, int]) -> bool:
        """Would a merge across the seam come before the merge that made the part?

        At equal scores the leftmost comes first: the seam lies right of a merge inside the left
        token and left of one inside the right token.
        """
        return across > limit[0] or (across == limit[0] and limit[1] == 1)

    def word(self, word: str) -> list[str]:
        """Tokens of a word, as pieces or single characters outside the vocabulary."""
        size = len(word)
        last: list[str | None] = [None] * (size + 1)
        ends: dict[int, list[str]] = {}
        for end, piece in self.automaton.iter(word):
            ends.setdefault(end + 1, []).append(piece)
        for end in range(1, size + 1):
            for piece in ends.get(end, ()):
                start = end - len(piece)
                if start == 0 or self.fits(last[start], piece):
                    last[end] = piece
                    break
            else:
                last[end] = word[end - 1]
        tokens, end = [], size
        while end:
            tokens.append(last[end])
            end -= len(last[end])
        return tokens[::-1]

    def ids(self, word: str) -> list[int]:
        out: list[int] = []
        for token in self.word(word):
            found = self.id_of.get(token)
            if found is None:
                out += [self.byte_id[byte] for byte in token.encode()]
            else:
                out.append(found)
        return out

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return [i for word in WORD.findall(marked) for i in self.ids(word)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces and bytes joined, the mark before the text dropped."""
        parts: list[bytes] = []
        for at in ids:
            if at in self.byte_value:
                parts.append(bytes([self.byte_value[at]]))
            elif at not in self.silent:
                parts.append(self.text[at].replace(SPACE, " ").encode())
        text = b"".join(parts).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text

    def _known(self, word: str) -> tuple[str, int, str]:
        """A word's ids joined by commas, their number, and the word decoded from them."""
        found = self.known.get(word) or self.older.get(word)
        if found is None:
            ids = self.ids(word)
            if self.byte_value.keys().isdisjoint(ids):
                decoded = "".join([self.text[i] for i in ids]).replace(SPACE, " ")
            else:
                decoded = self.decode([self.space, *ids])
            found = (",".join(map(str, ids)), len(ids), decoded)
        if len(word) <= WORD_CHARS:
            if len(self.known) >= KNOWN_WORDS:
                self.older, self.known = self.known, {}
            self.known[word] = found
        return found

    @property
    def space(self) -> int:
        return self.id_of[SPACE]

    def joined(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the text decoded from them."""
        if not text:
            return 0, "", ""
        get, make = self.known.get, self._known
        words = [
            get(word) or make(word) for word in WORD.findall(SPACE + text.replace(" ", SPACE))
        ]
        decoded = "".join([w[2] for w in words])
        return (
            sum([w[1] for w in words]),
            ",".join([w[0] for w in words]),
            decoded[1:] if decoded.startswith(" ") else decoded,
        )


_MODELS: dict[str, Pieces] = {}


def pieces_of(model_file: str) -> Pieces:
    """One for each Python worker, whatever the number of tasks it runs."""
    if model_file not in _MODELS:
        _MODELS[model_file] = Pieces(model_file)
    return _MODELS[model_file]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(
    docs: DataFrame, model_file: str, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id and ids (array of int) of each row."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    return row_by_row(
        rows, "ids array<int>", lambda t: (pieces_of(model_file).encode(t or ""),)
    )


def decode_documents(
    encoded: DataFrame, model_file: str, *, key: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """doc_id and the text decoded from each row's ids."""
    rows = encoded.select(encoded[key].alias("doc_id"), encoded[ids].alias("ids"))
    return row_by_row(rows, "text string", lambda i: (pieces_of(model_file).decode(i or []),))


def round_trip(
    docs: DataFrame, model_file: str, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: both ways in one pass over the texts."""
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))

    def work(text: str | None) -> tuple[int, str, str]:
        n, ids, decoded = pieces_of(model_file).joined(text or "")
        return n, _sha(ids), _sha(decoded)

    return row_by_row(rows, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", work)
