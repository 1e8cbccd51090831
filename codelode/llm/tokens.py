"""Token ids of texts by a tokenizer file of the ``tokenizers`` library, with a memo of words.

The default tokenizer splits at white space before anything else, so a text's ids are the ids of its
white-space-separated pieces in order. Each distinct piece is encoded once and remembered; a text is then
put together from remembered ids. Pieces of plain letters go to the library joined in one long text, others
one by one. Files whose splitting is not known to be so are encoded text by text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import quiet_threads

#: Distinct pieces remembered by one Python worker; older ones are forgotten by generations.
MEMO_PIECES = 600_000
_open: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Encodes Arrow arrays of texts to ids without special tokens."""

    def __init__(self, path: str):
        quiet_threads()
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_piece = self._splits_at_space(spec)
        self.plain = None
        if self.by_piece and spec["model"].get("end_of_word_suffix") == "</w>":
            self.plain = Tokenizer(self.full.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence(
                [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
            )
            ends = np.zeros(self.full.get_vocab_size(with_added_tokens=True) + 1, dtype=bool)
            for token, k in self.full.get_vocab(with_added_tokens=False).items():
                ends[k] = token.endswith("</w>")
            self.ends = ends

    @staticmethod
    def _splits_at_space(spec: dict) -> bool:
        """Whether white space is dropped by the pre-tokenizer and no step looks across it."""
        pre = spec.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        pattern = (first.get("pattern") or {}).get("Regex", "")
        norm = spec.get("normalizer") or {}
        kinds = {x["type"] for x in norm.get("normalizers", [norm] if norm else [])}
        return first.get("type") == "Split" and bool(first.get("invert")) and first.get("behavior") == "Removed" and "[^\\s" in pattern and " " not in pattern and kinds <= {"NFC", "Replace", "Lowercase"}

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not remembered; a trailing mark after a letter is a piece of its own."""
        young, old = self.young, self.old
        if len(young) + len(pieces) > MEMO_PIECES:
            self.old, self.young = young, {"": b""}
            young, old = self.young, self.old
        plain, odd, cut, named = set(), set(), [], []
        for p in pieces:
            core = p
            if len(p) > 1 and p[-1] in ".,;:!?" and p[-2].isalpha() and p[-2].lower().isalpha():
                core = p[:-1]
                cut.append(p)
                if p[-1] not in young:
                    odd.add(p[-1])
            if self.plain is not None and core.isalpha() and max(core) < "İ":
                low = core.lower()
                if low != core:
                    named.append((core, low))
                if low not in young:
                    if low in old:
                        young[low] = old[low]
                    else:
                        plain.add(low)
            elif core not in young:
                odd.add(core)
        if plain:
            words = list(plain)
            ids = np.asarray(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(words):
                data, begin = ids.tobytes(), 0
                for w, stop in zip(words, (stops * 4).tolist()):
                    young[w] = data[begin:stop]
                    begin = stop
            else:
                odd |= plain
        if odd:
            words = list(odd)
            for w, e in zip(words, self.full.encode_batch_fast(words, add_special_tokens=False)):
                young[w] = np.asarray(e.ids, dtype="<u4").tobytes()
        for core, low in named:
            young[core] = young[low]
        for p in cut:
            young[p] = young[p[:-1]] + young[p[-1]]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one uint32 array, and the offsets of each text in it; ``end_id`` is added to every text."""
        if not self.by_piece:
            rows = [np.asarray(e.ids, dtype="<u4") for e in self.full.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.array([len(r) for r in rows], dtype=np.int64)
            ids = np.concatenate(rows) if rows else np.zeros(0, "<u4")
        else:
            split = pc.ascii_split_whitespace(texts)
            bounds = split.offsets.to_numpy().astype(np.int64)
            bounds = bounds - bounds[0]
            coded = split.flatten().dictionary_encode()
            pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            young, old = self.young, self.old
            missing = []
            for p in pieces:
                if p not in young:
                    if p in old:
                        young[p] = old[p]
                    else:
                        missing.append(p)
            if missing:
                held = {p: young[p] for p in pieces if p in young} if len(young) + len(missing) > MEMO_PIECES else None
                self._learn(missing)
                if held:
                    self.young.update(held)
                young = self.young
            parts = [young[p] for p in pieces]
            lens = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            store = np.frombuffer(b"".join(parts), dtype="<u4")
            starts = np.cumsum(lens) - lens
            codes = coded.indices.to_numpy()
            n = lens[codes]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            ids = store[np.repeat(starts[codes] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, "<u4")
            edges = np.concatenate([[0], ends])
            sizes = np.diff(edges[bounds])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        if end_id is not None:
            ids = np.insert(ids, offsets[1:], np.uint32(end_id))
            offsets = offsets + np.arange(len(offsets))
        return ids.astype("<u4", copy=False), offsets


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, kept between batches and tasks."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
