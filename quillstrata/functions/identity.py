"""Identity expressions: canonical object ids, opaque ids, addresses and their kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of an object id: plain, hyphenated, in braces or as a URN.
_HEX = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_SPELLINGS = rf"^(?:[0-9a-f]{{32}}|{_HEX}|\{{{_HEX}\}}|urn:uuid:{_HEX})$"
#: Kinds of address by the variant that holds them.
ADDRESS_KINDS = {
    "object": "semantic_object",
    "unit": "semantic_unit",
    "region": "semantic_region",
    "identifier": "identifier",
    "occurrence": "occurrence",
    "temporal_anchor": "temporal_anchor",
    "retrieval_surface": "retrieval_surface",
}


def object_id(text: Column) -> Column:
    """Canonical hyphenated form of an object id, or null if it is none."""
    low = F.lower(text)
    digits = F.regexp_replace(low, r"^urn:uuid:|[{}-]", "")
    parts = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(low.rlike(_SPELLINGS), F.concat_ws("-", *parts))


def opaque_id(text: Column) -> Column:
    """The id as it is, or null if it is empty or only white space of any script."""
    return F.when(~text.rlike(r"^\p{IsWhite_Space}*$"), text)


def region_address(owner: Column, address: Column) -> Column:
    """Struct of a canonical object id and a structural address, or null if either is none."""
    parsed, place = object_id(owner), opaque_id(address)
    return F.when(parsed.isNotNull() & place.isNotNull(), F.struct(parsed.alias("object_id"), place.alias("address")))


def address_kind(variant: Column) -> Column:
    """Kind of an address variant; total over the known ones, null otherwise."""
    pairs = [F.lit(x) for pair in ADDRESS_KINDS.items() for x in pair]
    return F.create_map(*pairs)[variant]
