"""Ids of texts and texts of ids, as public tokenizer files define them."""

from __future__ import annotations

import functools
import json

import numpy as np

_PROBE = "Don't stop 12 é ß\n\n  naïve 中文\t<tag> it's  "
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The printable characters that stand for bytes in byte-level files; fixed values of the format.
_TO_BYTE = {chr(b): b for b in _SHOWN} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def vocabulary(path: str) -> int:
    """One more than the largest id."""
    spec = _spec(path)
    vocab = spec["model"]["vocab"]
    ids = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    return max([*ids, *(t["id"] for t in spec.get("added_tokens", []))], default=0) + 1


@functools.cache
def encoder(path: str, plain: bool = False):
    """A function from a text to its ids (unsigned 32-bit), special tokens not added.

    If plain, added tokens such as an end mark are ordinary text where they occur
    inside a text.  Byte-level BPE files whose ids are in merge order are run by a
    second engine for speed; a probe must agree, and texts with an added token or
    that the engine refuses go to the first one.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = plain

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    spec = _spec(path)
    if spec["model"].get("type") != "BPE" or "ByteLevel" not in json.dumps(spec.get("pre_tokenizer")) or spec.get("normalizer"):
        return slow
    import tiktoken

    added = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(_TO_BYTE[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    if fast.encode_ordinary(_PROBE) != slow(_PROBE).tolist():
        return slow

    def encode(text: str) -> np.ndarray:
        if len(text) > 1 << 20 or any(a in text for a in added):
            return slow(text)
        try:
            return np.asarray(fast.encode_to_numpy(text), np.uint32)
        except BaseException as e:  # the engine panics on some inputs
            if type(e).__name__ != "PanicException":
                raise
            return slow(text)

    return encode


@functools.cache
def decoder(path: str):
    """A function from ids to the bytes of their text, for byte-level files."""
    spec = _spec(path)
    if "ByteLevel" not in json.dumps(spec.get("decoder")):
        raise ValueError("not a byte-level tokenizer")
    table = {i: bytes(_TO_BYTE[c] for c in token) for token, i in spec["model"]["vocab"].items()}
    table |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    return lambda ids: b"".join(map(table.__getitem__, ids))
