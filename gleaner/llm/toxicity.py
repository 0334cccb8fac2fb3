"""Toxicity by weak supervision.

Many voters look at a text: one for each lexicon word, one for each lexicon, patterns over where words of
the lexicons stand, a few set phrases, and one that votes clean. No list here knows every language and slang,
so a further lexicon is mined: words, word pairs and word beginnings that labelled toxic texts show much more
often than others; likewise lexicon words that labelled texts show to mean something else here stop voting.
Both are found on four fifths of the learning rows and vote on the rest, so a row's own label never moves a
vote on that row, and labels are no votes themselves. With ``mine`` off they only set the class balance.

A generative label model, fitted without looking at any label, estimates how often each voter fires on toxic
and on clean texts (its accuracy) and how far voters still move together within a class (their correlations);
correlated voters share one vote's weight. A linear classifier over word n-grams and lexicon hits is then
trained on the model's posterior labels, and scores every text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import WORDS, mixed, rolling
from .learn import Sparse, found, labelled_sample, sample_features, scored, sigmoid

THRESHOLD = 0.5

#: Word lists, by kind and language. ASCII letters in lower case; other letters as written.
LEXICONS = {
    "insult": "idiot idiots moron morons imbecile loser losers clown clowns fool fools jerk creep freak coward nitwit dimwit halfwit dunce buffoon bozo",
    "contempt": "pathetic worthless disgusting stupid dumb useless ridiculous despicable repulsive vile revolting contemptible braindead brainless",
    "dehumanising": "scum trash garbage vermin filth parasite parasites subhuman cockroach cockroaches maggot maggots leech rat rats swine pig pigs",
    "profanity": "fuck fucking fucked fucker shit shitty bullshit bitch bastard asshole arsehole cunt dick dickhead prick wanker whore slut damn crap",
    "threat": "kill murder strangle stab rape lynch exterminate slaughter behead maim",
    "hate": "hate hates hated despise loathe detest",
    "slur_general": "retard retarded cretin degenerate savage barbarian lunatic psycho",
    "insult_fr": "imbécile crétin débile connard connasse salaud salope ordure abruti minable pourriture merde putain",
    "insult_de": "arschloch dreckig dreck abschaum trottel depp schwachkopf idioten scheiße scheiss hurensohn wertlos widerlich",
    "insult_es": "idiota imbécil estúpido estúpida basura escoria mierda asqueroso asquerosa inútil pendejo cabrón puta patético",
}
#: Second-person words that a pattern looks for near a lexicon word.
YOU = "you your youre u ya tu te vous toi du dich dir ihr usted vosotros ti"
#: Set phrases of two words.
PHRASES = "shut up|go die|kill yourself|drop dead|hate you|get lost|ta gueule|ferme la|halt maul|verpiss dich|cállate idiota|vete mierda"

#: What a mined voter needs: toxic rows, as a number and as a share of all rows, and the share of toxic ones among its rows.
MINED_ROWS, MINED_LEAST, MINED_SHARE = 3, 0.002, 0.9
#: Patterns of the mined lexicon: so many of its entries in one text.
MINED_SEVERAL = (2, 3, 5)
#: Parts of the learning rows: what the labels of the others name votes on a part.
PARTS = 5
#: A lexicon word stops voting if it shows in that many labelled rows and fewer than that share are toxic.
VETO_ROWS, VETO_SHARE = 3, 0.5
#: Standard errors by which an n-gram must tell the posterior classes apart to enter the classifier.
APART = 5.0
#: Bytes of the word beginnings that count as features.
BEGINNINGS = (4, 5, 6)

_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _hashed(words: str) -> np.ndarray:
    return np.sort(mixed(WORDS.of([w.encode() for w in words.split()])))


_LEXICON_WORDS = _hashed(" ".join(LEXICONS.values()))
_GROUPS = [_hashed(words) for words in LEXICONS.values()]
_YOU = _hashed(YOU)
_PHRASES = np.sort(np.concatenate([rolling(WORDS.of(p.encode().split()), 2) for p in PHRASES.split("|")]))
_WORD_GROUP = np.array([next(g for g, group in enumerate(_GROUPS) if w in group) for w in _LEXICON_WORDS])
#: Ids below this are voters, not n-grams.
VOTERS = 4096
_FIRST_GROUP = len(_LEXICON_WORDS)
_YOU_NEAR, _TWO_KINDS, _DENSE, _PHRASE, _CLEAN = range(_FIRST_GROUP + len(_GROUPS), _FIRST_GROUP + len(_GROUPS) + 5)


def features(text: bytes) -> np.ndarray:
    """Sorted distinct ids: voters that fire on the text (below VOTERS), and its word n-grams."""
    words = text.lower().translate(_LETTERS).split()
    if not words:
        return np.empty(0, np.uint32)
    raw = WORDS.of(words)
    one, two = mixed(raw), rolling(raw, 2)
    own = np.unique(one)
    hits = found(_LEXICON_WORDS, own)
    fires = list(hits)
    if len(hits):
        for g, group in enumerate(_GROUPS):
            if len(found(group, own)):
                fires.append(_FIRST_GROUP + g)
        at = np.flatnonzero(np.isin(one, _LEXICON_WORDS))
        you = np.flatnonzero(np.isin(one, _YOU))
        if len(you) and np.abs(at[:, None] - you[np.clip(np.searchsorted(you, at)[:, None] + np.array([-1, 0]), 0, len(you) - 1)]).min() <= 3:
            fires.append(_YOU_NEAR)
        if len(hits) >= 2:
            fires.append(_TWO_KINDS)
        if len(at) * 50 >= len(words):
            fires.append(_DENSE)
    elif len(words) >= 5:
        fires.append(_CLEAN)
    if len(found(_PHRASES, np.unique(two))):
        fires.append(_PHRASE)
    each = set(words)  # of word beginnings there are few, so their hashes are mostly at hand
    starts = [mixed(WORDS.of([w[:n] for w in each]) ^ np.uint64(n)) for n in BEGINNINGS]
    grams = (np.concatenate([own, two, *starts]) >> np.uint64(32)).astype(np.uint32)
    return np.concatenate([np.sort(np.array(fires, np.uint32)), np.unique(np.maximum(grams, VOTERS))])


def judged(ids: np.ndarray, vetoed: np.ndarray) -> np.ndarray:
    """``ids`` as if the ``vetoed`` lexicon words were in no lexicon: in this corpus they mean something else."""
    voters = ids[ids < VOTERS]
    hits = voters[voters < _FIRST_GROUP]
    good = hits[~np.isin(hits, vetoed)]
    if len(good) == len(hits):
        return ids
    kept = np.isin(voters, [_PHRASE] + [_YOU_NEAR, _DENSE] * bool(len(good)))
    fires = [*good, *(_FIRST_GROUP + np.unique(_WORD_GROUP[good])), *voters[kept], *[_TWO_KINDS] * (len(good) > 1), *[_CLEAN] * (not len(good))]
    return np.concatenate([np.sort(np.array(fires, np.uint32)), ids[ids >= VOTERS]])


def label_model(votes: np.ndarray, prior: float, rounds: int = 40) -> dict:
    """Fit the generative model to a (rows x voters) 0/1 array, whose last voter votes clean.

    Returns the prior, each voter's rate of firing by class, the correlations left within classes, for each
    row and voter the votes among which correlated voters share its evidence (it is divided by that), the log
    odds ``base`` of a row without votes, and the posterior probability of each row. A voter's silence says the
    same of every row on which it is silent, so all silence is in ``base``, which is such that the posteriors'
    mean is ``prior``, the share of toxic rows. The start gives a row the more, the more voters for toxic fire
    on it; that alone tells which class is which.
    """
    votes = votes.astype(np.float32)
    n, m = votes.shape
    prior = float(np.clip(prior, 1e-3, 0.5))
    post = np.array([0.01, 0.5, 0.9, 0.95])[np.minimum(votes[:, :-1].sum(1), 3).astype(int)]
    corr, shared = np.zeros((m, m)), np.ones((n, m), np.float32)
    for step in range(rounds):
        t = (post @ votes + 0.1) / (post.sum() + 1)
        c = ((1 - post) @ votes + 0.1) / ((1 - post).sum() + 1)
        if step in (rounds // 4, rounds // 2):  # correlations within classes, at the rates so far
            cov = np.zeros((m, m))
            for rates, weight in ((t, post), (c, 1 - post)):
                rest = (votes - rates.astype(np.float32)) * np.sqrt(weight).astype(np.float32)[:, None]
                cov += rest.T @ rest / n
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.maximum(cov / scale[:, None] / scale[None, :], 0) * (1 - np.eye(m))
            shared = 1 + votes @ corr.astype(np.float32)
        gain = np.log(t / c) - np.log((1 - np.minimum(t, 0.999)) / (1 - np.minimum(c, 0.999)))
        evidence = (votes / shared) @ gain
        low, high = -40.0, 40.0
        for _ in range(50):
            base = (low + high) / 2
            low, high = (base, high) if sigmoid(base + evidence).mean() < prior else (low, base)
        post = sigmoid(base + evidence)
    return {"prior": prior, "base": base, "gain": gain, "toxic": t, "clean": c, "correlations": corr, "shared": shared, "posterior": post}


def _hits(rows: list[np.ndarray]) -> np.ndarray:
    hits = np.zeros((len(rows), _FIRST_GROUP), bool)
    for i, r in enumerate(rows):
        hits[i, r[r < _FIRST_GROUP]] = True
    return hits


def _vetoed(count: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Lexicon words that labelled rows show to mean something else."""
    return np.flatnonzero((count >= VETO_ROWS) & (toxic < VETO_SHARE * count))


def named_by_others(x: Sparse, hits: np.ndarray, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part of the rows the (mined, vetoed) ids that the labels of all other parts name; row i is in part i % PARTS.

    ``x`` holds the rows' n-grams, ``hits`` which lexicon words they have. Mined are the n-grams that toxic
    labels go with; of those that stand in the very same rows, as those of copies do, one.
    """
    sums = x.back(np.random.default_rng(5).random(len(labels)))
    single = np.zeros(len(x.ids), bool)
    single[np.unique(np.round(sums, 9), return_index=True)[1]] = True
    y, part, out = (labels == 1).astype(float), np.arange(len(labels)) % PARTS, []
    for f in range(PARTS):
        other = (part != f).astype(float)
        count, toxic = x.back(other), x.back(other * y)
        good = (toxic >= max(MINED_ROWS, MINED_LEAST * other.sum())) & (toxic >= MINED_SHARE * count) & (x.ids >= VOTERS) & single
        out.append((x.ids[good], _vetoed(hits[part != f].sum(0), hits[(part != f) & (labels == 1)].sum(0))))
    return out


def votes_of(rows: list[np.ndarray], each: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(rows x voters) 0/1: the voters of the lists and patterns, mined ones, and last the one that votes clean."""
    known = _CLEAN + 1
    words = np.unique(np.concatenate([e[0] for e in each]))
    votes = np.zeros((len(rows), known + len(words) + len(MINED_SEVERAL)), np.float32)
    for i, r in enumerate(rows):
        own, veto = each[i % PARTS]
        own_votes, hits = judged(r, veto), own[np.isin(own, r)]
        votes[i, own_votes[own_votes < VOTERS]] = 1
        votes[i, known + found(words, hits)] = 1
        votes[i, known + len(words) :] = len(hits) >= np.array(MINED_SEVERAL)
    votes[:, _CLEAN] *= ~votes[:, known:].any(1)
    others = np.flatnonzero(votes.sum(0) >= max(2, len(rows) // 2000))
    return np.hstack([votes[:, others[others != _CLEAN]], votes[:, [_CLEAN]]])


def fit(rows: list[np.ndarray], labels: np.ndarray, steps: int = 300, ridge: float = 5e-5, mine: bool = True) -> dict:
    """The linear classifier, trained on the label model's posteriors. No rows: scores of nearly 0."""
    if not len(rows):
        return {"ids": np.empty(0, np.uint32), "w": np.empty(0), "bias": -3.0, "vetoed": np.empty(0, np.int64)}
    hits = _hits(rows)
    veto = _vetoed(hits.sum(0), hits[labels == 1].sum(0)) if mine else np.empty(0, np.int64)
    x = Sparse([judged(r, veto) for r in rows])
    each = named_by_others(x, hits, labels) if mine else [(np.empty(0, np.uint32), np.empty(0, np.int64))] * PARTS
    model = label_model(votes_of(rows, each), labels.mean())
    target = model["posterior"]
    # n-grams that do not tell the posterior classes apart only add noise to the classifier
    n1, n = target.sum(), len(rows)
    seen = x.back(np.ones(n))
    apart = (x.back(target) - seen * n1 / n) / np.sqrt(np.maximum(seen * (n1 / n) * (1 - n1 / n) * (1 - seen / (n + 1)), 1e-9))
    kept = np.flatnonzero((np.abs(apart) >= APART) | (x.ids < VOTERS))
    ids, inside = x.ids[kept], np.full(len(x.ids), -1, np.int32)
    inside[kept] = np.arange(len(kept), dtype=np.int32)
    columns, owner = inside[x.columns], x.owner
    columns, owner = columns[columns >= 0], owner[columns >= 0]
    w, bias = np.zeros(len(ids)), float(np.log(target.mean() / max(1 - target.mean(), 1e-6)))
    gw, gb = np.full(len(w), 1e-8), 1e-8
    for _ in range(steps):
        error = sigmoid(np.bincount(owner, w[columns], minlength=n) + bias) - target
        g = np.bincount(columns, error[owner], minlength=len(w)) / n + ridge * w
        b = error.mean()
        gw += g * g
        gb += b * b
        w -= 0.3 * g / np.sqrt(gw)
        bias -= 0.3 * b / np.sqrt(gb)
    # lexicon hits that the sample never had count as the usual one does
    new = np.setdiff1d(np.arange(_FIRST_GROUP, _CLEAN), ids).astype(np.uint32)
    lexical = w[(ids >= _FIRST_GROUP) & (ids < _CLEAN)]
    usual = float(np.median(lexical)) if len(lexical) else 3.0
    order = np.argsort(np.concatenate([ids, new]), kind="stable")
    return {"ids": np.concatenate([ids, new])[order], "w": np.concatenate([w, np.full(len(new), max(usual, 0.0))])[order], "bias": float(bias), "vetoed": veto, "label_model": model}


def probability(model: dict, ids: np.ndarray) -> float:
    return float(sigmoid(model["w"][found(model["ids"], judged(ids, model["vetoed"]))].sum() + model["bias"]))


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, mine: bool = True) -> DataFrame:
    """``docs`` with held_out, score (probability of toxic) and predicted.

    Fitted on at most TRAIN_ROWS labelled rows outside the held-out fold. A null text is scored as an empty
    one; an empty table stays empty; without usable labels scores are near 0. Columns of ``docs`` by the
    names of the three results are replaced; equal texts have equal scores.
    """
    rows, y = sample_features(docs, labelled_sample(labels, label), features)
    return scored(docs, features, probability, {k: v for k, v in fit(rows, y, mine=mine).items() if k != "label_model"}, threshold)
