"""SHA-256 with a state that one task can hand on to the next; hashlib has none to give."""

from __future__ import annotations

import _hashlib
import ctypes
from functools import cache

#: Bytes of OpenSSL's SHA256_CTX: eight words of the digest, the length, a block, and what is in it.
STATE = 112


@cache
def library() -> ctypes.CDLL:
    """The OpenSSL that hashlib uses."""
    found = ctypes.CDLL(_hashlib.__file__)
    found.SHA256_Update.argtypes = (ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t)
    found.SHA256_Final.argtypes = (ctypes.c_void_p, ctypes.c_void_p)
    return found


def started() -> bytes:
    state = ctypes.create_string_buffer(STATE)
    library().SHA256_Init(state)
    return state.raw


def fed(state: bytes, data: bytes) -> bytes:
    """The state after more bytes."""
    after = ctypes.create_string_buffer(state, STATE)
    library().SHA256_Update(after, data, len(data))
    return after.raw


def finished(state: bytes) -> str:
    """The digest of all bytes so far, in lowercase hex."""
    last, out = ctypes.create_string_buffer(state, STATE), ctypes.create_string_buffer(32)
    library().SHA256_Final(out, last)
    return out.raw.hex()
