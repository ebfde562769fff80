"""What a contract is, from its runtime code, storage slots and interface answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.functions.opcodes import bare_hex, instructions
from deltascope.operators.labels import records

# Storage slots, interface ids, selectors and the clone template of the public standards.
SLOTS = {
    "implementation": "360894a13ba1a3210667c828492db98dca3e2076cc3735a920a3ca505d382bbc",
    "beacon": "a3f0ad74e5423aebfd80d3ef4346578335a9a72aeaee59ff6cb3582b35133d50",
    "admin": "b53127684a568b3173ae13b9f8a6016e243e63b6e8ee1178d6a717850b5d6103",
}
ERC721, ERC1155, LOUPE = "80ac58cd", "d9b67a26", "48e2b093"
ERC20_SELECTORS = ("a9059cbb", "70a08231", "18160ddd")
UUPS_SELECTORS = ("52d1902d", "3659cfe6", "4f1ef286")
DIAMOND_CUT = "1f931c1c"
CLONE = "^363d3d373d3d3d363d73[0-9a-f]{40}5af43d82803e903d91602b57fd5bf3$"
CREATES, DELEGATECALL = ("f0", "f5"), "f4"


def slot_word(storage: Column, role: str) -> Column:
    """The word in a slot, with or without 0x in the key; null when absent or zero."""
    word = F.coalesce(F.try_element_at(storage, F.lit("0x" + SLOTS[role])), F.try_element_at(storage, F.lit(SLOTS[role])))
    return F.when(~bare_hex(word).rlike("^0*$"), word)


def word_address(word: Column) -> Column:
    return F.when(word.isNotNull(), F.concat(F.lit("0x"), F.right(F.lpad(bare_hex(word), 64, "0"), F.lit(40))))


def supports(answers: Column, interface: str) -> Column:
    return F.coalesce(F.try_element_at(answers, F.lit("0x" + interface)), F.try_element_at(answers, F.lit(interface)), F.lit(False))


def is_erc165(answers: Column) -> Column:
    return F.coalesce(F.exists(F.map_values(answers), lambda v: F.coalesce(v, F.lit(False))), F.lit(False))


def is_proxy(code: Column, storage: Column) -> Column:
    slots = F.coalesce(*[slot_word(storage, r) for r in SLOTS]).isNotNull()
    return slots | F.array_contains(instructions(code), DELEGATECALL)


def is_factory(code: Column) -> Column:
    return F.arrays_overlap(instructions(code), F.array(*[F.lit(c) for c in CREATES]))


def _has_all(code: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.contains(bare_hex(code), F.lit(p))
    return out


def erc_type(code: Column, answers: Column) -> Column:
    return F.when(supports(answers, ERC721), "erc721").when(supports(answers, ERC1155), "erc1155").when(_has_all(code, ERC20_SELECTORS), "erc20")


def upgradability(code: Column, storage: Column, answers: Column) -> Column:
    """struct(is_upgradable, mechanism, admin): clone, diamond, beacon, transparent, slot, selectors, none, in this order."""
    admin = word_address(slot_word(storage, "admin"))

    def verdict(yes: bool, mechanism: str, who: Column) -> Column:
        return F.struct(F.lit(yes).alias("is_upgradable"), F.lit(mechanism).alias("mechanism"), who.alias("admin"))

    none = F.lit(None).cast("string")
    uups = F.lit(False)
    for s in UUPS_SELECTORS:
        uups = uups | F.contains(bare_hex(code), F.lit(s))
    return (
        F.when(bare_hex(code).rlike(CLONE), verdict(False, "minimal_proxy_immutable", none))
        .when(supports(answers, LOUPE) | F.contains(bare_hex(code), F.lit(DIAMOND_CUT)), verdict(True, "diamond", admin))
        .when(slot_word(storage, "beacon").isNotNull(), verdict(True, "beacon", admin))
        .when(admin.isNotNull(), verdict(True, "eip1967_transparent", admin))
        .when(slot_word(storage, "implementation").isNotNull() | uups, verdict(True, "uups", none))
        .otherwise(verdict(False, "none", none))
    )


def classify(contracts: DataFrame) -> DataFrame:
    """Label records of contracts(address, code, storage map<string,string>, answers map<string,boolean>)."""
    code, storage, answers = F.col("code"), F.col("storage"), F.col("answers")
    df = contracts.withColumns({"_erc": erc_type(code, answers), "_proxy": is_proxy(code, storage), "_factory": is_factory(code), "_up": upgradability(code, storage, answers)})
    token = F.col("_erc").isNotNull()
    label = F.when(token, F.concat(F.lit("ERC-"), F.substr(F.col("_erc"), F.lit(4)), F.lit(" token"))).when(F.col("_proxy"), "Proxy contract").when(F.col("_factory"), "Factory contract").otherwise(F.col("address"))
    return records(df, "heuristic", "low", address=F.col("address"), label=label, category=F.when(token, "token").otherwise("unknown"), is_proxy=F.col("_proxy"), is_factory=F.col("_factory"), erc_type=F.col("_erc"), is_upgradable=F.col("_up.is_upgradable"), upgrade_mechanism=F.col("_up.mechanism"), upgrade_admin=F.col("_up.admin"))


def latest_slots(reads: DataFrame, diffs: DataFrame) -> DataFrame:
    """address, slot, value: the newest of reads and diffs (address, slot, value, block_number); of equal blocks, the larger value."""
    return reads.unionByName(diffs).groupBy(F.lower("address").alias("address"), "slot").agg(F.max_by("value", F.struct("block_number", "value")).alias("value"))


def structural_inputs(addresses: DataFrame, reads: DataFrame, diffs: DataFrame, codes: DataFrame) -> DataFrame:
    """address, code, storage, answers of every address asked for (lower case); what was not seen is empty."""
    asked = addresses.select(F.lower("address").alias("address")).distinct()
    few = lambda df: df.join(asked, F.lower(df["address"]) == asked["address"], "left_semi")
    want = [f"0x{s}" for s in SLOTS.values()]
    slots = latest_slots(*[few(df.filter(F.col("slot").isin(*want))) for df in (reads, diffs)])
    storage = slots.groupBy("address").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("storage"))
    code = few(codes).groupBy(F.lower("address").alias("address")).agg(F.max_by("code", F.struct("block_number", "code")).alias("code"))
    empty = F.create_map().cast("map<string,string>")
    out = asked.join(storage, "address", "left").join(code, "address", "left")
    return out.select("address", F.nullif("code", F.lit("")).alias("code"), F.coalesce("storage", empty).alias("storage"), F.create_map().cast("map<string,boolean>").alias("answers"))
