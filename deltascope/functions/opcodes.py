"""Opcode bytes and bytecode text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The machine's opcode bytes and names; the numbered ranges are generated below.
NAMED = """
00 STOP 01 ADD 02 MUL 03 SUB 04 DIV 05 SDIV 06 MOD 07 SMOD 08 ADDMOD 09 MULMOD 0a EXP 0b SIGNEXTEND
10 LT 11 GT 12 SLT 13 SGT 14 EQ 15 ISZERO 16 AND 17 OR 18 XOR 19 NOT 1a BYTE 1b SHL 1c SHR 1d SAR 20 KECCAK256
30 ADDRESS 31 BALANCE 32 ORIGIN 33 CALLER 34 CALLVALUE 35 CALLDATALOAD 36 CALLDATASIZE 37 CALLDATACOPY
38 CODESIZE 39 CODECOPY 3a GASPRICE 3b EXTCODESIZE 3c EXTCODECOPY 3d RETURNDATASIZE 3e RETURNDATACOPY 3f EXTCODEHASH
40 BLOCKHASH 41 COINBASE 42 TIMESTAMP 43 NUMBER 44 PREVRANDAO 45 GASLIMIT 46 CHAINID 47 SELFBALANCE 48 BASEFEE
49 BLOBHASH 4a BLOBBASEFEE 50 POP 51 MLOAD 52 MSTORE 53 MSTORE8 54 SLOAD 55 SSTORE 56 JUMP 57 JUMPI 58 PC 59 MSIZE
5a GAS 5b JUMPDEST 5c TLOAD 5d TSTORE 5e MCOPY 5f PUSH0
f0 CREATE f1 CALL f2 CALLCODE f3 RETURN f4 DELEGATECALL f5 CREATE2 fa STATICCALL fd REVERT fe INVALID ff SELFDESTRUCT
""".split()
MNEMONICS = {int(b, 16): name for b, name in zip(NAMED[::2], NAMED[1::2])}
MNEMONICS |= {first + i: f"{name}{i + start}" for first, name, count, start in ((0x60, "PUSH", 32, 1), (0x80, "DUP", 16, 1), (0x90, "SWAP", 16, 1), (0xA0, "LOG", 5, 0)) for i in range(count)}

#: One instruction of lower-case hex: a push with its data (cut short at the end, too), else two digits.
_PUSHES = "|".join(f"{0x5F + n:02x}[0-9a-f]{{{2 * n}}}" for n in range(1, 33))
TOKEN = f"(?:{_PUSHES}|[67][0-9a-f](?=[0-9a-f]*$)[0-9a-f]*|[0-9a-f]{{2}})"


def mnemonic(byte: Column) -> Column:
    table = F.create_map(*[x for b, n in sorted(MNEMONICS.items()) for x in (F.lit(b), F.lit(n))])
    return F.when(byte.isNotNull(), F.coalesce(table[byte.cast("int")], F.format_string("UNKNOWN_0x%02x", byte.cast("int"))))


def explode_opcodes(rows: DataFrame, keys: list[str], arrays: tuple[str, ...] = ("opcode", "opcode_count", "opcode_gas_baseline", "opcode_gas_schedule")) -> DataFrame:
    """One row per element of the parallel arrays, with the mnemonic."""
    out = rows.select(*keys, F.inline(F.arrays_zip(*[F.col(a) for a in arrays])))
    out = out.toDF(*keys, "opcode_byte", "count", "gas_baseline", "gas_schedule")
    return out.withColumn("opcode", mnemonic(F.col("opcode_byte")))


def bare_hex(c: Column) -> Column:
    """Lower-case hex without 0x; empty for null."""
    v = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(v.startswith("0x"), F.substr(v, F.lit(3))).otherwise(v)


def instructions(code: Column) -> Column:
    """Opcode bytes (two hex digits each) in order, without the data that pushes carry."""
    return F.transform(F.regexp_extract_all(bare_hex(code), F.lit(TOKEN), F.lit(0)), lambda t: F.substring(t, 1, 2))
