"""Which destinations lie outside the private network and the home prefixes.

The address is parsed and classified with built-in SQL functions, so the rule
costs no Python round trip.  The special-purpose ranges are those of the IANA
registries; 100.64.0.0/10 counts as neither private nor reserved.  In the IPv6
steps ``transform(array(x), a -> ...)[0]`` evaluates x once for many uses.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, functions as F

from logvigil.constants import HOME_PREFIXES
from logvigil.functions.text import BLANKS

# --- fixed values: IPv4 ranges that are not abroad, as leading octets: the
# special-purpose ranges, then the home prefixes; 192.0.0.9 and .10 are excepted ---
V4_SPECIAL = (
    "0", "10", "127", "169[.]254", "172[.](?:1[6-9]|2[0-9]|3[01])", "192[.]0[.]2", "192[.]168",
    "198[.]1[89]", "198[.]51[.]100", "203[.]0[.]113", "22[4-9]", "23[0-9]", "24[0-9]", "25[0-5]",
)
V4_SPECIAL_BUT_TWO = "192[.]0[.]0[.](?!(?:9|10)$)"

# --- fixed values: IPv6 ranges ---
# outside 2000::/3 only the old site-local block fec0::/10 is neither private nor reserved
V6_OPEN = ("2000::/3", "fec0::/10")
V6_SPECIAL = ("2001::/23", "2001:db8::/32", "2002::/16")
V6_EXCEPTED = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48",
    "2001:20::/28", "2001:30::/28",
)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = f"{_OCTET}(?:[.]{_OCTET}){{3}}"


def _v6_within(groups: str, networks: tuple[str, ...]) -> str:
    """Tests on the eight 16-bit groups, compared under the mask of each prefix."""
    tests = []
    for text in networks:
        net = ipaddress.ip_network(text)
        words = [int(w, 16) for w in net.network_address.exploded.split(":")]
        masks = [int(w, 16) for w in net.netmask.exploded.split(":")]
        tests.append(" and ".join(
            f"({groups}[{i}] & {m}) = {w}" for i, (w, m) in enumerate(zip(words, masks)) if m
        ))
    return "(" + " or ".join(f"({t})" for t in tests) + ")"


def _v6_public(address: str) -> str:
    # a zone id is dropped; a dotted tail becomes two groups
    bare = f"regexp_replace({address}, '%[^%]+$', '')"
    tail = f"regexp_extract(t, ':({_V4})$', 1)"
    octet = [f"lpad(hex(try_cast(split_part({tail}, '.', {i}) as int)), 2, '0')" for i in (1, 2, 3, 4)]
    plain = f"""transform(array({bare}), t -> if(t like '%.%',
        concat(substring(t, 1, length(t) - length({tail})),
               {octet[0]}, {octet[1]}, ':', {octet[2]}, {octet[3]}), t))[0]"""
    # '::' stands for one or more zero groups; without it all eight are written
    parts = "if({0} = '', cast(array() as array<string>), split({0}, ':'))"
    head, rest = parts.format("h[0]"), parts.format("get(h, 1)")
    groups = f"""transform(array(split({plain}, '::')), h -> case
        when size(h) = 1 and size({head}) = 8 then {head}
        when size(h) = 2 and size({head}) + size({rest}) <= 7 then
             concat({head}, array_repeat('0', 8 - size({head}) - size({rest})), {rest})
        end)[0]"""
    numbers = f"""transform(array({groups}), w -> if(forall(w, x -> x rlike '^[0-9a-fA-F]{{1,4}}$'),
        transform(w, x -> cast(conv(x, 16, 10) as int)), null))[0]"""
    return (
        f"transform(array({numbers}), g -> {_v6_within('g', V6_OPEN)} and not "
        f"({_v6_within('g', V6_SPECIAL)} and not {_v6_within('g', V6_EXCEPTED)}))[0]"
    )


def cross_border(column: str) -> Column:
    """True for a routable address outside the home prefixes; malformed is false.

    IPv4, by far the commonest, takes a single pattern; only texts with a colon
    go through the IPv6 steps.
    """
    near = "|".join([*V4_SPECIAL, *[p.rstrip(".") for p in HOME_PREFIXES]])
    abroad = f"^(?!(?:{near})[.])(?!{V4_SPECIAL_BUT_TWO}){_V4}$"
    address = f"btrim(`{column}`, '{BLANKS}')"
    return F.expr(f"""coalesce(case when instr(`{column}`, ':') > 0
        then transform(array({address}), a -> {_v6_public('a')})[0]
        else {address} rlike '{abroad}' end, false)""")
