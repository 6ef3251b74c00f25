"""Row-at-a-time model of matching and merging, only for tests.

Small and slow on purpose: it walks mentions in order and keeps plain dicts,
so the distributed results can be compared with it."""

from __future__ import annotations


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return 1 - distance(a, b) / max(len(a), len(b))


def places_alike(a, b) -> float:
    """``a`` and ``b`` are (street, number) or None."""
    if a is None or b is None:
        return 0.0
    return ratio(a[0], b[0]) * 0.7 + (0.3 if a[1] == b[1] else 0.0)


def resolve(mentions: list[dict], aliases: dict[str, str]) -> dict:
    """ord -> founder's ord, for the mentions that end up in a venue."""
    founded: list[dict] = []
    out = {}
    for m in sorted(mentions, key=lambda m: m["ord"]):
        by_key = {v["key"]: v for v in founded}
        hit = by_key.get(m["key"]) or by_key.get(aliases.get(m["key"]))
        if hit is None:
            near = [(v, ratio(m["key"], v["key"])) for v in founded]
            near = [(v, s) for v, s in near if s >= m["threshold"]]
            local = [(v, s) for v, s in near if m["city"] and v["city"] and v["city"].lower() == m["city"].lower()]
            for v, s in local or near:
                score = s * 0.8 + places_alike(m["place"], v["place"]) * 0.2
                if hit is None or score > best:
                    hit, best = v, score
        if hit is None and m["can_found"]:
            founded.append(m)
            hit = m
        if hit is not None:
            out[m["ord"]] = hit["ord"]
    return out


def slugs(bases: list[str]) -> list[str]:
    used, out = set(), []
    for base in bases:
        slug, n = base, 1
        while slug in used:
            n += 1
            slug = f"{base}-{n}"
        used.add(slug)
        out.append(slug)
    return out


NUMERIC = ["svd", "dn", "di", "krogguiden", "falstaff", "thatsup"]


def merge(mentions: list[dict], founder_of: dict) -> dict:
    """Fold mentions, in order, into one plain dict per venue."""
    venues: dict = {}
    for m in sorted(mentions, key=lambda m: m["ord"]):
        if m["ord"] not in founder_of:
            continue
        guide, michelin = m["source"] == "whiteguide-review", m["source"] == "michelin"
        at = founder_of[m["ord"]]
        new = at not in venues
        if new:
            venues[at] = {
                "address": m["address"] or "", "city": m["match_city"] or "", "type": m["venue_type"] or "restaurant", "lat": None, "lng": None,
                "price": "", "ratings": {}, "sources": {}, "names": {}, "quotes": {}, "first_name": m["name"],
            }
            if guide:
                venues[at].update(lat=m["lat"], lng=m["lng"])
        v = venues[at]
        if m["lat"] and m["lng"] and not v["lat"]:
            v.update(lat=m["lat"], lng=m["lng"])
        v["address"] = v["address"] or m["address"] or ""
        v["city"] = v["city"] or m["fill_city"] or ""
        v["price"] = v["price"] or m["price_range"] or ""
        if not m["is_sub"] and not michelin and v["type"] == "restaurant" and m["venue_type"]:
            v["type"] = m["venue_type"]
        if michelin and m["venue_type"] == "hotel":
            v["type"] = "hotel"
        if not m["is_sub"]:
            v["names"][m["source"]] = m["name"]
        v["sources"].setdefault(m["source"], m["url"])
        text = (m["body_text"] or "").strip()
        if m["source"] in ("michelin", "whiteguide-review", "falstaff", "dn-review", "svd-review", "di") and len(text) >= 20:
            v["quotes"].setdefault(m["source"], text)
        tag = (m["tags"] or [None])[0]
        if guide:
            v["ratings"].setdefault("whiteguide", tag)
        elif michelin:
            if m["tags"]:
                v["ratings"].setdefault("michelin", tag)
        elif m["score"] and m["score"] > 0:
            v["ratings"].setdefault(m["rating_key"], m["score"])
    return venues


def best_name(v: dict) -> str:
    for s in ("michelin", "whiteguide-review", "dn-review", "svd-review", "di", "krogguiden"):
        if v["names"].get(s):
            return v["names"][s]
    return next(iter(v["names"].values()), "") or v["first_name"]
