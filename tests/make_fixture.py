"""A small linkage task as TSV files. Nothing is drawn at random: entity i is spelled from i in mixed radix, and a record's damage is
the entry of a schedule that its running number names, so each kind of noise comes equally often and a failure can be read off a number."""

from __future__ import annotations

import itertools
from pathlib import Path

BRANDS = ("Halden", "Corvex", "Mirrow", "Tamsin", "Oakhart", "Velora", "Quillon", "Brightsea", "Norvik", "Pellam", "Zanther")
TRADES = ("Dairy", "Optics", "Freight", "Ceramics", "Printing", "Timber", "Roofing", "Seeds")
WAYS = (("Street", "St"), ("Road", "Rd"), ("Lane", "Ln"), ("Avenue", "Ave"))
TOWNS = ("Marlow", "Kestrel Bay", "Dunford", "Ashby", "Tolland")
FORMS = {"US": ("Incorporated", "Inc"), "India": ("Private Limited", "Pvt Ltd"), "Chile": ("Limited", "Ltd")}
DEVANAGARI = {"Dairy": "डेयरी", "Seeds": "सीड्स", "Timber": "टिम्बर"}


def entity(i: int) -> dict:
    """The parts of entity i's name and address."""
    brand = (i * 7 + 3) % len(BRANDS)
    second = BRANDS[(i * 5 + brand + 1) % len(BRANDS)].lower()
    return {"brand": BRANDS[brand], "second": f"{second[:4]}{i}", "trade": TRADES[i % len(TRADES)], "number": 11 + 13 * i % 890, "street": f"{BRANDS[(i * 3 + 2) % len(BRANDS)]} {TOWNS[i % len(TOWNS)]}", "way": i % len(WAYS), "town": TOWNS[(i // 5) % len(TOWNS)]}


def spelled(e: dict, form: str, way: int = 0, parts=("brand", "second", "trade")) -> tuple[str, str]:
    name = " ".join([*(e[p] for p in parts), form]).strip()
    return name, f"{e['number']} {e['street']} {WAYS[e['way']][way]}, {e['town']}"


#: Kinds of damage: entity, its country's forms -> (name, address).
DAMAGE = (
    lambda e, f: spelled(e, f[1]),
    lambda e, f: spelled(e, f[0], 1),
    lambda e, f: spelled(e, "", 1),
    lambda e, f: (spelled(e, f[1])[0].upper(), spelled(e, f[1])[1].replace(",", " -")),
    lambda e, f: spelled(e, f[1], 1, ("trade", "brand", "second")),
    lambda e, f: (spelled(e, f[0])[0].replace(e["brand"], e["brand"][:-1]), spelled(e, f[0])[1]),
    lambda e, f: (spelled(e, f[1])[0], f"{e['number']} {e['street']}"),
    lambda e, f: (spelled(e, f[0])[0].replace(e["trade"], DEVANAGARI.get(e["trade"], e["trade"])), spelled(e, f[0], 1)[1]),
    lambda e, f: ("The " + spelled(e, f[1])[0], "Plot " + spelled(e, f[1])[1]),
)


def split(entities: int, countries: tuple[str, ...], first: int = 0) -> tuple[dict[int, list], list]:
    """Records of three sources, and the truth. Entity i has 1 + i % 3 copies, but none where 8
    divides i, dealt to sources 2 and 3 in turn; a record of no entity follows each second entity."""
    sources: dict[int, list] = {1: [], 2: [], 3: []}
    truth, damage, strangers = [], itertools.cycle(enumerate(DAMAGE)), itertools.count(10_000)
    for i in range(first, first + entities):
        country, e = countries[i % len(countries)], entity(i)
        mine, found = f"S1-{i}", []
        sources[1].append((mine, *spelled(e, FORMS[country][0]), country))
        for copy in range(1 + i % 3 if i % 8 else 0):
            kind, damaged = next(damage)
            side = 2 + (i + copy) % 2
            found.append(f"S{side}-{i}.{copy}.{kind}")
            sources[side].append((found[-1], *damaged(e, FORMS[country]), country))
        truth.append((mine, ",".join(found)))
        if i % 2:
            n = next(strangers)
            sources[2 + i // 2 % 2].append((f"S{2 + i // 2 % 2}-x{n}", *spelled(entity(n), FORMS[country][1]), country))
    return sources, truth


def write(root: str, train: int = 300, test: int = 120) -> None:
    at = Path(root)
    at.mkdir(parents=True, exist_ok=True)

    def tsv(name: str, head: tuple, rows: list) -> None:
        (at / name).write_text("".join("\t".join(r) + "\n" for r in (head, *rows)))

    for name, n, countries, first in (("train", train, ("US", "India"), 0), ("test", test, ("US", "India", "Chile"), train)):
        sources, truth = split(n, countries, first)
        for i, rows in sources.items():
            tsv(f"{name}_source{i}.tsv", ("entity_id", "business_name", "business_address", "country"), rows)
        tsv(f"{name}_ground_truth.tsv", ("source1_entity_id", "matched_entity_ids"), truth)
