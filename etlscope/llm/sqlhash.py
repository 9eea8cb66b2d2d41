"""XXH64 and SimHash votes as standard SQL with 128-bit integers, for the SQL equivalents of the fingerprint queries."""

from __future__ import annotations

# The primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_U = "::UHUGEINT"
_LOW = f"& 18446744073709551615{_U}"


def _mul(a: str, n: int) -> str:
    return f"(({a}) * {n}{_U} {_LOW})"


def _add(a: str, *n: int) -> str:
    return f"(({a} + {sum(n) % (1 << 64)}{_U}) {_LOW})"


def _rotl(a: str, r: int) -> str:
    return f"((({a}) * {1 << r}{_U} {_LOW}) + (({a}) >> {64 - r}{_U}))"


def _round(acc: str, lane: str) -> str:
    return _mul(_rotl(f"(({acc} + {_mul(lane, P2)}) {_LOW})", 31), P1)


def _merge(h: str, v: str) -> str:
    return _add(_mul(f"xor({h}, {_round(f'0{_U}', v)})", P1), P4)


def _read(at: str, size: int) -> str:
    """``size`` bytes from byte ``at``; x is the hex text backwards, so bytes come in the right order with their halves swapped."""
    return f"('0x' || substr(x, CAST(2 * (n - ({at}) - {size}) + 1 AS BIGINT), {2 * size}))::UBIGINT"


def _swapped(v: str) -> str:
    """The halves of each byte put right."""
    halves = 0x0F0F0F0F0F0F0F0F
    return f"(({v} & {halves}::UBIGINT){_U} * 16{_U} + (({v} >> 4) & {halves}::UBIGINT){_U})"


def _lanes(indices: str, at: str, size: int) -> str:
    """List of the little-endian numbers of ``size`` bytes at ``at``, an expression over i."""
    return f"list_transform(list_transform({indices}, lambda i: {_read(at, size)}), lambda v: {_swapped('v')})"


def xxh64(name: str, source: str, text: str, seed: str, keep: str) -> str:
    """CTEs up to ``name``: the columns ``keep`` of ``source`` and h, the XXH64 of ``text`` with ``seed`` (expressions over source)."""
    t = f"{name}_"
    v = [f"list_reduce({_lanes('range(0, stripes)', f'32 * i + {8 * k}', 8)}, lambda a, l: {_round('a', 'l')}, {_add('seed', *start)})" for k, start in enumerate(((P1, P2), (P2,), (), ((1 << 64) - P1,)))]
    joined = f"(({_rotl('v0', 1)} + {_rotl('v1', 7)} + {_rotl('v2', 12)} + {_rotl('v3', 18)}) {_LOW})"
    eights, ones = _lanes("range(0, (n % 32) // 8)", "32 * stripes + 8 * i", 8), _lanes("range(n - n % 4, n)", "i", 1)
    steps = [
        f"SELECT {keep}, {text} AS body, ({seed}){_U} AS seed FROM {source}",
        f"SELECT * EXCLUDE (body), reverse(hex(encode(body))) AS x, octet_length(encode(body)) AS n, octet_length(encode(body)) // 32 AS stripes FROM {t}0",
        f"SELECT *, {', '.join(f'{e} AS v{k}' for k, e in enumerate(v))} FROM {t}1",
        f"SELECT *, {joined} AS m FROM {t}2",
        *[f"SELECT * EXCLUDE (m), {_merge('m', f'v{k}')} AS m FROM {t}{3 + k}" for k in range(4)],
        f"SELECT * EXCLUDE (m, v0, v1, v2, v3), (CASE WHEN stripes > 0 THEN m ELSE {_add('seed', P5)} END + n{_U}) {_LOW} AS h FROM {t}7",
        f"SELECT * REPLACE (list_reduce({eights}, lambda a, l: {_add(_mul(_rotl(f'xor(a, {_round(f"0{_U}", "l")})', 27), P1), P4)}, h) AS h) FROM {t}8",
        f"SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {_add(_mul(_rotl(f'xor(h, {_mul(_swapped(_read("n - n % 8", 4)), P1)})', 23), P2), P3)} ELSE h END AS h) FROM {t}9",
        f"SELECT * REPLACE (list_reduce({ones}, lambda a, l: {_mul(_rotl(f'xor(a, {_mul("l", P5)})', 11), P1)}, h) AS h) FROM {t}10",
        f"SELECT * REPLACE ({_mul(f'xor(h, h >> 33{_U})', P2)} AS h) FROM {t}11",
        f"SELECT * REPLACE ({_mul(f'xor(h, h >> 29{_U})', P3)} AS h) FROM {t}12",
    ]
    ctes = [f"{t}{i} AS MATERIALIZED ({s})" if i in (0, 7) else f"{t}{i} AS ({s})" for i, s in enumerate(steps)]
    return ",\n".join([*ctes, f"{name} AS MATERIALIZED (SELECT {keep}, CAST(xor(h, h >> 32{_U}) AS UBIGINT) AS h FROM {t}13)"])


def fingerprint(h: str = "h", weight: str = "1") -> str:
    """Aggregate: bit k is 1 if the weights of the hashes that set it are over half of all; zero without hashes."""
    total = f"sum({weight})"
    return "CAST(coalesce(" + " + ".join(f"CASE WHEN 2 * sum(CAST(({h} >> {k}) & 1 AS BIGINT) * {weight}) > {total} THEN {1 << k}{_U} ELSE 0{_U} END" for k in range(64)) + ", 0) AS UBIGINT)"


def hex16(fp: str) -> str:
    return f"lpad(lower(hex({fp})), 16, '0')"
