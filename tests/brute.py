"""Plain Python versions of what SQL can't express: sequence ratios, alignment and the audit, one row at a time."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from citeproof import lexicons as L


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def words(x):
    return re.findall(r"\w+", x.lower())


def title_tokens(x):
    return [w for w in words(x) if re.fullmatch(r"[a-z\u4e00-\u9fa5]{2,}", w) and w not in L.TITLE_STOP_WORDS]


def stem(w):
    if len(w) > 4:
        for s in L.STEM_SUFFIXES:
            if w.endswith(s):
                return w[: -len(s)]
    return w


def stems(x):
    out = set()
    for w in words(x):
        if len(w) >= 2:
            out.add(stem(w))
            out.update(stem(s) for s in L.SYNONYMS.get(w, []))
    return out


def trigrams(x):
    clean = re.sub(r"[^\w\s]", "", x.lower()).strip()
    return {clean[i : i + 3] for i in range(len(clean) - 2)}


def jaccard(a, b):
    return len(a & b) / max(len(a | b), 1)


def overlap(a, b):
    return len(a & b) / max(len(a), 1)


def any_of(x, names):
    return any(n in x for n in names)


def channels(claim, sentence):
    """The lexical and the semantic score of a claim and a sentence."""
    a, b = claim.lower(), sentence.lower()
    r = ratio(a, b)
    lexical = round(0.5 * overlap(stems(claim), stems(sentence)) + 0.3 * jaccard(trigrams(claim), trigrams(sentence)) + 0.2 * r, 2)
    named = [(any_of(a, c), any_of(b, c)) for c in L.CONCEPTS]
    if any(x or y for x, y in named):
        share = sum(x and y for x, y in named) / sum(x or y for x, y in named)
        meaning = 0.7 * share + 0.3 * r
    else:
        three = lambda x: {w for w in words(x) if len(w) >= 3}
        meaning = 0.5 * overlap(three(claim), three(sentence)) + 0.5 * r
    return lexical, round(min(1.0, meaning), 2)


def clauses(x):
    end = r"(?:[;,]|\b(?:" + "|".join(L.CLAUSE_WORDS_EN) + r")\b|" + "|".join(L.CLAUSE_WORDS_ZH) + ")"
    parts = [p.strip() for p in re.split(end, x, flags=re.I)]
    return [p for p in parts if len(p) >= 3] or [x]


def negated(x, targets):
    ws = [w for w in words(x) if re.fullmatch("[a-z]+", w)]
    for i, w in enumerate(ws):
        if w in L.NEGATIONS_EN and (not targets or any(stem(y) in targets for y in ws[i + 1 : i + 5])):
            return True
    return any_of(x, L.NEGATIONS_ZH)


def conflict(claim, sentence):
    parts = clauses(sentence)
    if len(parts) > 1:
        sentence = max(parts, key=lambda c: len(stems(c) & stems(claim)))
    c, s = claim.lower(), sentence.lower()
    up, down = L.RISING, L.FALLING
    if (any_of(c, up) and any_of(s, down) and not any_of(c, down)) or (any_of(c, down) and any_of(s, up) and not any_of(s, down)):
        return True
    chars = lambda x: set(x) - set(" ,.，。!！?？\t\n")
    if any_of(c, L.NEGATIONS_ZH) != any_of(s, L.NEGATIONS_ZH) and len(chars(c) & chars(s)) >= 3:
        return True
    shared = stems(c) & stems(s)
    return bool(shared) and negated(claim, shared) != negated(sentence, shared)


def align(claim, abstract):
    """(best sentence, score, state)."""
    if not claim or not abstract:
        return "", 0.0, "UNVERIFIED"
    found = [s.strip() for s in re.split(r"[。！？；.!?;\n]+\s*", abstract)]
    found = [s for s in found if len(s) >= 4]
    best, total, lexical, semantic = "", -1.0, 0.0, 0.0
    for s in found or [abstract[:150]]:
        lex, sem = channels(claim, s)
        score = 0.5 * sem + 0.5 * lex if found else 0.0
        if score > total:
            best, total, lexical, semantic = s, score, lex, sem
    peak = round(total, 2)
    blended = max(semantic, peak) if semantic >= 0.35 and lexical < 0.10 else max(0.5 * semantic + 0.5 * lexical, peak)
    score = round(blended, 2)
    if conflict(claim, best) or conflict(claim, abstract):
        return best, 0.15, "CONTRADICTED"
    return best, score, "SUPPORTED" if score >= 0.5 else "PARTIAL" if score >= 0.3 else "NEUTRAL"


def title_score(a, b):
    a, b = a.strip(), b.strip()
    if not a or not b:
        return 0.0
    r = ratio(a.lower(), b.lower())
    x, y = title_tokens(a), title_tokens(b)
    t = jaccard(set(x), set(y)) if x and y else r
    return round(0.6 * r + 0.4 * t, 3)


def author_score(wanted, given):
    wanted, given = title_tokens(" ".join(wanted)), title_tokens(" ".join(given))
    if not wanted or not given:
        return 0.0
    hit = (1.0 if len(wanted[0]) > 3 else 0.7) if wanted[0] in given else 0.0
    return round(0.7 * hit + 0.3 * overlap(set(wanted), set(given)), 3)


def candidate_score(title, authors, year, candidate):
    """candidate: a row with title, authors and year; its score, 0 where it is rejected."""
    t, a = title_score(title, candidate.title), author_score(authors, candidate.authors or [])
    y = None if year is None or candidate.year is None else {0: 1.0, 1: 0.5}.get(abs(year - candidate.year), 0.0)
    tokens = title_tokens(title)
    if len(title.strip()) >= 12 and len(tokens) >= 3 and t < 0.30:
        return 0.0
    if not (t >= 0.70 or (a >= 0.5 and t >= 0.4) or (a >= 0.5 and (y or 0) >= 0.5 and t >= 0.35)):
        return 0.0
    parts = [(t, 0.45)] + [(a, 0.30)] * (a > 0) + [(y, 0.15)] * (y is not None)
    return round(sum(s * w for s, w in parts) / sum(w for _, w in parts), 3)


def best_candidate(title, authors, year, candidates):
    """(candidate, score, margin, confidence, the two best of the uncertain) or None; candidates in their order."""
    fit = sorted(((candidate_score(title, authors, year, c), -k) for k, c in enumerate(candidates)), reverse=True)
    fit = [(s, candidates[-k]) for s, k in fit if s >= 0.40]
    if not fit:
        return None
    score, margin = fit[0][0], fit[0][0] - fit[1][0] if len(fit) > 1 else 1.0
    level = "HIGH" if score >= 0.75 and margin >= 0.10 else "MEDIUM" if score >= 0.60 and margin >= 0.05 else "UNCERTAIN"
    return fit[0][1], score, margin, level, [c for _, c in fit[:2]]
