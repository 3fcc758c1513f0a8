"""Addresses of cryptocurrency wallets: candidates by shape in the JVM, checksums in Arrow-batched Python."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lurescope.runtime import ship

#: The alphabets of Base58 and Bech32, the latter's generator (BIP 173) and its two final values (BIP 173, 350).
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
FINAL = (1, 0x2BC830A3)
#: Version bytes of Base58 addresses by their first character.
VERSIONS = {"1": ("bitcoin", (0x00, 0x05)), "3": ("bitcoin", (0x00, 0x05)), "L": ("litecoin", (0x30, 0x32)), "M": ("litecoin", (0x30, 0x32)), "T": ("tron", (0x41,))}

_58 = "[1-9A-HJ-NP-Za-km-z]"
SHAPE = (
    rf"(?<![A-Za-z0-9])(?:[13]{_58}{{25,34}}|(?:bc|ltc)1[ac-hj-np-z02-9]{{11,87}}|[LM]{_58}{{26,33}}|T{_58}{{33}}"
    rf"|0x[0-9a-fA-F]{{40}}|[48][0-9AB]{_58}{{93}})(?![A-Za-z0-9])"
)
WALLETS = "array<struct<currency:string,address:string>>"


def base58_version(address: str) -> int | None:
    """Version byte of a Base58Check address of 25 bytes; None if its checksum is wrong."""
    number = sum(BASE58.index(c) * 58**i for i, c in enumerate(reversed(address)))
    zeros = len(address) - len(address.lstrip(BASE58[0]))
    data = bytes(zeros) + number.to_bytes((number.bit_length() + 7) // 8, "big")
    good = len(data) == 25 and hashlib.sha256(hashlib.sha256(data[:21]).digest()).digest()[:4] == data[21:]
    return data[0] if good else None


def bech32_holds(address: str) -> bool:
    """Whether the checksum of a lower-case Bech32 or Bech32m address holds."""
    prefix, _, data = address.rpartition("1")
    if len(data) < 6 or not set(data) <= set(BECH32):
        return False
    state = 1
    for symbol in [ord(c) >> 5 for c in prefix] + [0] + [ord(c) % 32 for c in prefix] + [BECH32.index(c) for c in data]:
        carry, state = state >> 25, (state % (1 << 25)) * 32 ^ symbol
        for bit, term in enumerate(GENERATOR):
            if carry >> bit & 1:
                state ^= term
    return state in FINAL


def currency(address: str) -> str | None:
    """Currency of a candidate; None if its checksum fails, or an Ethereum address has under five different digits."""
    if address.startswith("0x"):
        return "ethereum" if len(set(address[2:].lower())) > 4 else None
    if address.startswith(("bc1", "ltc1")):
        return ("bitcoin" if address[0] == "b" else "litecoin") if bech32_holds(address) else None
    if address[0] in "48":
        return "monero"
    name, versions = VERSIONS[address[0]]
    return name if base58_version(address) in versions else None


def _valid(candidates: pd.Series) -> pd.Series:
    named = lambda found: [{"currency": c, "address": a} for a in found if (c := currency(a))]
    return candidates.map(lambda found: [] if found is None else named(found))


def wallets(text: Column, most: int = 20) -> Column:
    """Wallet addresses of a whole text by first place, each once, the first ``most``; none for a null text."""
    ship(SparkSession.active())
    candidates = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SHAPE), F.lit(0)))
    return F.slice(F.pandas_udf(_valid, WALLETS)(candidates), 1, most)
