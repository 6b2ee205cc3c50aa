"""Plain versions that several tests use."""

import collections
import hashlib

from sievegrid.llm.token_alignment import ByteLevel, Piecewise
from sievegrid.llm.tokens import tokenizer_path


def plain_alignment(texts):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, all of them counted together."""
    first, second = ByteLevel.of(tokenizer_path()), Piecewise.of(tokenizer_path("piece_bpe_32k.model"))
    found, total = [], collections.Counter()
    for text in texts:
        sides, whole = [], (" " + (text or "")).encode()
        for ids, pieces in ((first.encoder.library.encode(" " + (text or ""), add_special_tokens=False).ids, first.pieces), (second.library.encode(text or ""), second.pieces)):
            at, side, joined = 0, [], b""
            for i in ids:
                piece = pieces.flat[pieces.begin[i] : pieces.begin[i] + pieces.size[i]].tobytes()
                side.append((i, at, at + len(piece)))
                at, joined = at + len(piece), joined + piece
            sides.append(side if text and joined == whole else None)
        a, b = sides if None not in sides else ([], [])
        groups, i, j = [], 0, 0
        for cut in sorted({t[2] for t in a} & {t[2] for t in b}):
            x, y = [t[0] for t in a[i:] if t[2] <= cut], [t[0] for t in b[j:] if t[2] <= cut]
            i, j = i + len(x), j + len(y)
            groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        links, k = [], 0
        for p, u, v in a:
            while k < len(b) and b[k][2] <= u:
                k += 1
            m = k
            while m < len(b) and b[m][1] < v:
                links.append((p, b[m][0]))
                m += 1
        total.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = collections.Counter()
    for (_, q), n in total.items():
        best[q] = max(best[q], n)
    return [(n, m, g, len(x), sum(total[p] == best[p[1]] for p in x), sum(total[p] for p in x), hashlib.sha256(s.encode()).hexdigest() if s else "") for n, m, g, x, s in found]
