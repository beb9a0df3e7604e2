"""The similarities of functions.strings by their definitions, one pair after the other."""

def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & places.get(y, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 lcs / (length of both); 1 for two empty strings."""
    n = len(a) + len(b)
    return 2 * lcs(a, b) / n if n else 1.0


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best indel ratio among the common tokens and each side's tokens, common ones first; 1 if one side's tokens are all common,
    0 if a side has none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    if not both:
        return indel_ratio(left, right)
    one, two = f"{both} {left}", f"{both} {right}"
    return max(indel_ratio(one, two), indel_ratio(both, one), indel_ratio(both, two))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro's similarity, raised by a tenth for each of up to four equal first characters where it is above 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    mine: list[str] = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [y for y, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro <= 0.7:
        return jaro
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)

SCORES = {"token_set": token_set_ratio, "token_sort": token_sort_ratio, "ratio": indel_ratio, "jaro": jaro_winkler}
