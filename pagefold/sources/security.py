"""The standard security handler: keys from passwords, object keys, encryption and decryption of strings and streams.

A file is unlocked inside the task that parses it. RC4 and AES come from the C library that Python's own hashes are linked with, if a
worker finds it and it gives known results; else from the plain forms here, which need no library but are a hundred times slower.
There, AES tables are made from the field's rule, a stream's blocks are decrypted together as arrays. Public-key handlers and signing
need more of such a library and aren't built.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import secrets
import sys
import types
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .objects import Name, Ref, Stream

#: What passwords are filled up with (a fixed value of the standard).
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


class Native:
    """RC4 and AES of libcrypto."""

    def __init__(self, library: str):
        c = ctypes.CDLL(library)
        self.calls = c.RC4_set_key, c.RC4, c.AES_set_encrypt_key, c.AES_set_decrypt_key, c.AES_cbc_encrypt
        for f, kinds in zip(self.calls, ("pip", "pspp", "pip", "pip", "ppsppi"), strict=True):
            f.argtypes = [{"p": ctypes.c_char_p, "i": ctypes.c_int, "s": ctypes.c_size_t}[k] for k in kinds]

    def rc4(self, key: bytes, data: bytes) -> bytes:
        state, out = ctypes.create_string_buffer(4096), ctypes.create_string_buffer(max(1, len(data)))
        self.calls[0](state, len(key), key)
        self.calls[1](state, len(data), data, out)
        return out.raw[: len(data)]

    def aes(self, key: bytes, start: bytes, data: bytes, back: bool) -> bytes:
        """CBC over whole blocks."""
        state, out = ctypes.create_string_buffer(4096), ctypes.create_string_buffer(max(1, len(data)))
        self.calls[3 if back else 2](key, 8 * len(key), state)
        self.calls[4](data, out, len(data), state, ctypes.create_string_buffer(start, 16), 0 if back else 1)
        return out.raw[: len(data)]

    def right(self) -> bool:
        """Whether known results come out."""
        block = bytes.fromhex("00112233445566778899aabbccddeeff")
        sealed = {16: "69c4e0d86a7b0430d8cdb78070b4c55a", 32: "8ea2b7ca516745bfeafc49904b496089"}
        same = all(self.aes(bytes(range(n)), bytes(16), block, False).hex() == x and self.aes(bytes(range(n)), bytes(16), bytes.fromhex(x), True) == block for n, x in sealed.items())
        return same and self.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def native() -> Native | None:
    """The C library, looked for once in a worker; None where it isn't there or gives other results."""
    cache = sys.modules.setdefault("_pagefold_worker", types.ModuleType("_pagefold_worker")).__dict__
    if "crypto" not in cache:
        cache["crypto"] = None
        for name in ("libcrypto.so.3", "libcrypto.so.1.1", ""):
            try:
                place = name or ctypes.util.find_library("crypto")
                found = Native(place) if place else None
            except (OSError, AttributeError):
                continue
            if found and found.right():
                cache["crypto"] = found
                break
    return cache["crypto"]


def rc4(key: bytes, data: bytes) -> bytes:
    if (c := native()) and 0 < len(key) <= 256:
        return c.rc4(key, data)
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out.append(b ^ s[(s[i] + s[j]) & 255])
    return bytes(out)


def file_key(password: bytes, o: bytes, p: int, file_id: bytes, revision: int, bits: int, encrypt_metadata: bool = True) -> bytes:
    """Key of revisions 2 to 4."""
    h = hashlib.md5((password + PAD)[:32] + o[:32] + (p & 0xFFFFFFFF).to_bytes(4, "little") + file_id + (b"\xff" * 4 if revision >= 4 and not encrypt_metadata else b""))
    key, n = h.digest(), bits // 8 if revision >= 3 else 5
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:n]).digest()
    return key[:n]


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    """What /U must hold for a key: all of it at revision 2, the first 16 bytes after that."""
    if revision == 2:
        return rc4(key, PAD)
    out = rc4(key, hashlib.md5(PAD + file_id).digest())
    for k in range(1, 20):
        out = rc4(bytes(b ^ k for b in key), out)
    return out


def owner_entry(owner: bytes, user: bytes, revision: int, bits: int) -> bytes:
    """/O, which encrypts the user's password under the owner's."""
    key, n = hashlib.md5((owner + PAD)[:32]).digest(), bits // 8 if revision >= 3 else 5
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    out = (user + PAD)[:32]
    for k in range(20 if revision >= 3 else 1):
        out = rc4(bytes(b ^ k for b in key[:n]), out)
    return out


def opens(password: bytes, o: bytes, u: bytes, p: int, file_id: bytes, revision: int, bits: int) -> bytes | None:
    """The file's key if the user's password is right."""
    key = file_key(password, o, p, file_id, revision, bits)
    made = user_entry(key, file_id, revision)
    return key if made[:16] == u[:16] else None


def _field() -> tuple[list[int], np.ndarray]:
    """The substitution box and the products of all pairs of bytes, from the rule of the field."""
    power, x = [0] * 255, 1
    for k in range(255):
        power[k] = x
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)  # times three
        x &= 0xFF
    log = {v: k for k, v in enumerate(power)}
    box = [0x63] * 256
    for v in range(1, 256):
        i = power[(255 - log[v]) % 255]
        box[v] = i ^ 0x63
        for _ in range(4):
            i = (i << 1 | i >> 7) & 0xFF
            box[v] ^= i
    logs, powers = np.array([log.get(v, 0) for v in range(256)]), np.array(power)
    product = powers[(logs[:, None] + logs[None, :]) % 255].astype(np.uint8)
    product[0, :] = product[:, 0] = 0
    return box, product


BOX, PRODUCT = _field()
UNBOX = np.argsort(np.array(BOX)).astype(np.uint8)
#: A column's share of the four bytes of a mixed column, as one number.
MIXED = [[int.from_bytes(bytes(int(PRODUCT[f, BOX[v]]) for f in np.roll((2, 1, 1, 3), k)), "big") for v in range(256)] for k in range(4)]
#: Where each byte of a block comes from when its rows are shifted back.
UNSHIFT = [(c - r) % 4 * 4 + r for c in range(4) for r in range(4)]


def _round_keys(key: bytes) -> list[int]:
    n = len(key) // 4
    words, factor = [int.from_bytes(key[4 * k : 4 * k + 4], "big") for k in range(n)], 1
    substituted = lambda w: int.from_bytes(bytes(BOX[b] for b in w.to_bytes(4, "big")), "big")
    for k in range(n, 4 * (n + 7)):
        w = words[-1]
        if k % n == 0:
            w = substituted((w << 8 | w >> 24) & 0xFFFFFFFF) ^ factor << 24
            factor = int(PRODUCT[2, factor])
        elif n > 6 and k % n == 4:
            w = substituted(w)
        words.append(words[k - n] ^ w)
    return words


def aes_encrypt(key: bytes, start: bytes, data: bytes, padded: bool = True) -> bytes:
    """CBC. padded adds the bytes that fill the last block."""
    if padded:
        data += bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
    if (c := native()) and len(key) in (16, 32) and len(start) == 16 and len(data) % 16 == 0:
        return c.aes(key, start, data, False)
    words, (m0, m1, m2, m3), out = _round_keys(key), MIXED, bytearray()
    last = len(words) - 4
    before = [int.from_bytes(start[4 * k : 4 * k + 4], "big") for k in range(4)]
    for at in range(0, len(data), 16):
        a, b, c, d = (int.from_bytes(data[at + 4 * k : at + 4 * k + 4], "big") ^ before[k] ^ words[k] for k in range(4))
        for k in range(4, last, 4):
            a, b, c, d = (
                m0[a >> 24] ^ m1[b >> 16 & 255] ^ m2[c >> 8 & 255] ^ m3[d & 255] ^ words[k], m0[b >> 24] ^ m1[c >> 16 & 255] ^ m2[d >> 8 & 255] ^ m3[a & 255] ^ words[k + 1],
                m0[c >> 24] ^ m1[d >> 16 & 255] ^ m2[a >> 8 & 255] ^ m3[b & 255] ^ words[k + 2], m0[d >> 24] ^ m1[a >> 16 & 255] ^ m2[b >> 8 & 255] ^ m3[c & 255] ^ words[k + 3],
            )
        before = [
            (BOX[x >> 24] << 24 | BOX[y >> 16 & 255] << 16 | BOX[z >> 8 & 255] << 8 | BOX[w & 255]) ^ words[last + k]
            for k, (x, y, z, w) in enumerate(((a, b, c, d), (b, c, d, a), (c, d, a, b), (d, a, b, c)))
        ]
        for w in before:
            out += w.to_bytes(4, "big")
    return bytes(out)


def aes_decrypt(key: bytes, start: bytes, data: bytes, padded: bool = True) -> bytes:
    """CBC, all blocks together; a wrong length or padding is an error."""
    if len(data) % 16:
        raise ValueError("no whole blocks")
    if (c := native()) and len(key) in (16, 32) and len(start) == 16:
        out = c.aes(key, start, data, True)
    else:
        keys = np.array([list(w.to_bytes(4, "big")) for w in _round_keys(key)], dtype=np.uint8).reshape(-1, 16)
        blocks = np.frombuffer(data, dtype=np.uint8).reshape(-1, 16)
        x = blocks ^ keys[-1]
        for k in range(len(keys) - 2, -1, -1):
            x = UNBOX[x[:, UNSHIFT]] ^ keys[k]
            if k:
                columns = x.reshape(-1, 4, 4)
                x = np.bitwise_xor.reduce([PRODUCT[f][np.roll(columns, -r, axis=2)] for r, f in enumerate((14, 11, 13, 9))]).reshape(-1, 16)
        out = (x ^ np.concatenate([np.frombuffer(start, dtype=np.uint8)[None, :], blocks[:-1]])).tobytes()
    if not padded:
        return out
    n = out[-1] if out else 0
    if not 1 <= n <= 16 or out[-n:] != bytes([n]) * n:
        raise ValueError("wrong padding")
    return out[:-n]


def password_hash(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    """Of revisions 5 and 6; user is /U where it is the owner's password."""
    k = hashlib.sha256(password + salt + user).digest()
    turn = 0
    while revision >= 6:
        e = aes_encrypt(k[:16], k[16:32], (password + k + user) * 64, padded=False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        turn += 1
        if turn >= 64 and e[-1] <= turn - 32:
            break
    return k[:32]


@dataclass
class Cipher:
    """How a file's strings and streams are encrypted. access: whose password opened it."""

    key: bytes
    strings: str | None  # RC4, AESV2, AESV3, or None for those that aren't encrypted
    streams: str | None
    revision: int
    metadata: bool = True
    access: str = "owner"
    entry: dict | None = None  # the encryption dictionary of a file that is written
    file_id: bytes = b""

    def _bytes(self, data: bytes, method: str | None, num: int, gen: int, back: bool) -> bytes:
        if method is None:
            return data
        key = object_key(self.key, num, gen, method == "AESV2", self.revision)
        if method == "RC4":
            return rc4(key, data)
        if back:
            return aes_decrypt(key, data[:16], data[16:]) if data else b""
        start = secrets.token_bytes(16)
        return start + aes_encrypt(key, start, data)

    def apply(self, x: Any, num: int, gen: int, back: bool) -> Any:
        """An indirect object with its strings and its stream's data encrypted, or decrypted."""
        if isinstance(x, bytes):
            return self._bytes(x, self.strings, num, gen, back)
        if isinstance(x, Stream):
            kind, filters = x.dict.get("Type"), x.dict.get("Filter")
            plain = kind == "XRef" or kind == "Metadata" and not self.metadata or "Crypt" in (filters if isinstance(filters, list) else [filters])
            if kind == "XRef":
                return x
            return Stream(self.apply(x.dict, num, gen, back), x.data if plain else self._bytes(x.data, self.streams, num, gen, back))
        if isinstance(x, dict):
            return {k: self.apply(v, num, gen, back) for k, v in x.items()}
        if isinstance(x, list):
            return [self.apply(v, num, gen, back) for v in x]
        return x


#: /V, /R and key bits of the ways to encrypt a file (fixed values).
WAYS = {"RC4-40": (1, 2, 40), "RC4-128": (2, 3, 128), "AES-128": (4, 4, 128), "AES-256-R5": (5, 5, 256), "AES-256": (5, 6, 256)}


def protect(way: str, user: bytes = b"", owner: bytes = b"owner", p: int = -44, file_id: bytes = b"") -> Cipher:
    """A cipher for a new file, with its encryption dictionary."""
    v, r, bits = WAYS[way]
    file_id = file_id or secrets.token_bytes(16)
    entry: dict[str, Any] = {"Filter": Name("Standard"), "V": v, "R": r, "Length": bits, "P": p}
    method = "RC4" if v < 4 else "AESV2" if v == 4 else "AESV3"
    if v >= 4:
        entry |= {"CF": {"StdCF": {"CFM": Name(method), "AuthEvent": Name("DocOpen"), "Length": bits // 8}}, "StmF": Name("StdCF"), "StrF": Name("StdCF")}
    if r < 5:
        o = owner_entry(owner, user, r, bits)
        key = file_key(user, o, p, file_id, r, bits)
        entry |= {"O": o, "U": user_entry(key, file_id, r).ljust(32, b"\0")}
    else:
        key, salts = secrets.token_bytes(32), secrets.token_bytes(32)
        u = password_hash(user, salts[:8], b"", r) + salts[:16]
        o = password_hash(owner, salts[16:24], u, r) + salts[16:]
        sealed = lambda password, salt, extra: aes_encrypt(password_hash(password, salt, extra, r), bytes(16), key, padded=False)
        perms = (p & 0xFFFFFFFF).to_bytes(4, "little") + b"\xff" * 4 + b"Tadb" + secrets.token_bytes(4)
        entry |= {"O": o, "U": u, "OE": sealed(owner, salts[24:], u), "UE": sealed(user, salts[8:16], b""), "Perms": aes_encrypt(key, bytes(16), perms, padded=False)}
    return Cipher(key, method, method, r, entry=entry, file_id=file_id)


def open_with(entry: dict, password: bytes, file_id: bytes) -> tuple[bytes, str] | None:
    """The file's key and whose password it is, or None if it is nobody's."""
    get = lambda k, kind, default: v if isinstance(v := entry.get(k), kind) else default
    r, p, o, u = get("R", int, 0), get("P", int, 0), get("O", bytes, b""), get("U", bytes, b"")
    if r >= 5:
        for name, own, sealed, extra in (("user", u, get("UE", bytes, b""), b""), ("owner", o, get("OE", bytes, b""), u[:48])):
            if len(own) >= 48 and password_hash(password[:127], own[32:40], extra, r) == own[:32]:
                return aes_decrypt(password_hash(password[:127], own[40:48], extra, r), bytes(16), sealed[:32], padded=False), name
        return None
    bits = get("Length", int, 40) if get("V", int, 0) > 1 else 40
    bits = 128 if get("V", int, 0) == 4 else bits
    metadata = entry.get("EncryptMetadata") is not False

    def as_user(given: bytes) -> bytes | None:
        key = file_key(given, o, p, file_id, r, bits, metadata)
        return key if user_entry(key, file_id, r)[:16] == u[:16] else None

    if key := as_user(password):
        return key, "user"
    own, n = hashlib.md5((password + PAD)[:32]).digest(), bits // 8 if r >= 3 else 5
    for _ in range(50 if r >= 3 else 0):
        own = hashlib.md5(own).digest()
    given = o[:32]
    for k in range(19 if r >= 3 else 0, -1, -1):
        given = rc4(bytes(b ^ k for b in own[:n]), given)
    key = as_user(given)
    return (key, "owner") if key else None


def cipher_of(file: Any, password: bytes) -> Cipher | None:
    """The cipher of an encrypted file. What can't be opened is a decision, and the file is read as it stands."""
    entry = file.resolve(file.trailer.get("Encrypt"))
    if not isinstance(entry, dict):
        return None
    entry = {k: file.resolve(v) for k, v in entry.items()}
    if entry.get("Filter") != "Standard":
        if not entry.get("Recipients") and not any(isinstance(f, dict) and f.get("Recipients") for f in (file.resolve(f) for f in (entry.get("CF") or {}).values())):
            file.decide(2, "7.6.5", "encrypted for certificates, but nobody is named", "left strings and streams as they are")
        else:
            file.decide(2, "7.6.5", "encrypted for the holders of certificates", "left strings and streams as they are, since no key is at hand")
        return None
    v, r = entry.get("V"), entry.get("R")
    if v not in (1, 2, 4, 5) or r not in (2, 3, 4, 5, 6):
        file.decide(2, "7.6.2", f"no known way of encryption: /V {v}, /R {r}", "left strings and streams as they are")
        return None
    ids = file.resolve(file.trailer.get("ID"))
    file_id = ids[0] if isinstance(ids, list) and ids and isinstance(ids[0], bytes) else b""
    try:
        opened = open_with(entry, password, file_id)
    except ValueError as e:
        opened = None
        file.decide(2, "7.6.4", f"the key can't be read: {e}", "left strings and streams as they are")
    if opened is None:
        file.decide(2, "7.6.4", "the password is neither the user's nor the owner's", "left strings and streams as they are")
        return None
    methods = []
    for k in ("StmF", "StrF"):
        rule = file.get(entry.get("CF"), entry.get(k) or "Identity") if v >= 4 else None
        name = str(file.get(rule, "CFM") or "None") if v >= 4 else "V2"
        methods.append({"V2": "RC4", "AESV2": "AESV2", "AESV3": "AESV3"}.get(name))
    if r >= 5 and isinstance(entry.get("Perms"), bytes):
        perms = aes_decrypt(opened[0], bytes(16), entry["Perms"][:16], padded=False)
        if perms[9:12] != b"adb" or perms[:4] != (entry.get("P", 0) & 0xFFFFFFFF).to_bytes(4, "little"):
            file.decide(1, "7.6.4.4", "/Perms says something else than /P", "went by /P")
    return Cipher(opened[0], methods[1], methods[0], r, entry.get("EncryptMetadata") is not False, opened[1])


def unlock(file: Any, password: bytes = b"") -> None:
    """Decrypts the strings and streams of a file's objects, all but the encryption dictionary itself."""
    cipher = cipher_of(file, password)
    if cipher is None:
        return
    file.access = cipher.access
    own = file.trailer.get("Encrypt")
    for num, (gen, x) in file.objects.items():
        if isinstance(own, Ref) and num == own.num:
            continue
        try:
            file.objects[num] = gen, cipher.apply(x, num, gen, back=True)
        except ValueError as e:
            file.decide(2, "7.6.2", f"object {num} can't be decrypted: {e}", "left it as it is")


def object_key(key: bytes, num: int, gen: int, aes: bool, revision: int) -> bytes:
    if revision >= 5:
        return key
    return hashlib.md5(key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")).digest()[: min(len(key) + 5, 16)]


def object_key_column(key: bytes, num: Column, gen: Column, aes: bool) -> Column:
    """The same as a column, for frames of objects."""
    little = lambda x, n: F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(x.cast("int"), 8 * k).bitwiseAND(F.lit(255)).cast("long")), 2, "0")) for k in range(n)))
    whole = F.concat(F.lit(key), little(num, 3), little(gen, 2), *([F.lit(b"sAlT")] if aes else []))
    return F.substring(F.unhex(F.md5(whole)), 1, min(len(key) + 5, 16))


def decrypt_aes(data: Column, key: Column) -> Column:
    """CBC with the first 16 bytes as the start; null if the padding is wrong."""
    return F.try_aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def signed_digest(data: bytes, ranges: list[int]) -> str:
    """SHA-256 over the byte ranges (offset, length) of a signature."""
    return hashlib.sha256(b"".join(data[a : a + n] for a, n in zip(ranges[::2], ranges[1::2], strict=False))).hexdigest()
