"""Weight correction against a direct reading of its branches."""

import itertools
import math

import pytest

from haulframe.plans import weights as W
from haulframe.sources import columns as C
from haulframe.sources.dimensions import COEFFICIENT_SCHEMA


def between(x):
    return x is not None and not math.isnan(x) and 0.5 <= x <= 1.5


def ratio(a, b):
    if a is None or b is None:
        return None
    if b == 0:
        return math.nan if a == 0 else math.inf
    return a / b


def expected(size, grams, n, size_max, w_sih, w_fb, w_obs, o_sih, o_fb, o_obs, obs_ok):
    relations = [w for w in (w_sih, w_fb, w_obs) if w is not None]
    one = len(relations) == 1 or (len(relations) > 1 and [o_sih, o_fb, o_obs].count("med") == 1)
    if one:
        order = [(o_sih == "med", w_sih), (o_fb == "med", w_fb), (o_obs == "med" and obs_ok, w_obs)]
    else:
        order = [(o_obs == "med" and obs_ok, w_obs), (o_fb == "med", w_fb), (o_sih == "med", w_sih)]
    order += [(obs_ok, w_obs), (w_fb is not None, w_fb), (w_sih is not None, w_sih), (True, None)]
    ref = next(w for ok, w in order if ok)
    total = mean = total_kg = mean_kg = None
    if size is not None and size_max is not None and size < size_max * 1.1:
        total, mean = ratio(ratio(grams, n), ref), ratio(grams, ref)
        kg = None if grams is None else grams * 1000
        total_kg, mean_kg = ratio(ratio(kg, n), ref), ratio(kg, ref)

    def over(margin):
        return size is not None and size_max is not None and size > size_max * margin

    single, several = n == 1, n is not None and n > 1
    branches = [
        (ref is None, W.NO_REFERENCE, grams),
        (n == 0, W.NO_CATCH, None),
        (size == 0, W.NO_SIZE, grams),
        (grams == 0, W.NO_WEIGHT, ref),
        (single and between(mean), W.SINGLE_OK, grams),
        (single and between(mean_kg), W.SINGLE_KG, grams and grams * 1000),
        (single, W.SINGLE_ABERRANT, ref),
        (several and between(total), W.TOTAL_KEPT, grams),
        (several and between(mean), W.MEAN_GIVEN, grams),
        (several and between(total_kg), W.TOTAL_KG, grams and grams * 1000),
        (several and between(mean_kg), W.SINGLE_KG, grams and grams * 1000),
        (True, W.ABERRANT, ref),
    ]
    text = next(t for ok, t, _ in branches[:1] + [(over(1.2), W.SIZE_ABERRANT, None)] + branches[1:] if ok)
    final = next(f for ok, _, f in branches[:1] + [(over(1.1), None, grams)] + branches[1:] if ok)
    if final is None:
        text = None
    elif final > 1_000_000:
        text, final = W.TOO_HEAVY, None
    if text and "TOTAL GARDÉ" in text or final is None or text in (W.NO_REFERENCE, W.NO_SIZE):
        line = final
    else:
        line = None if n is None else final * n
    return ref, text, final, line


def same(a, b):
    return a is b is None or (a is not None and b is not None and a == pytest.approx(b, rel=1e-12))


RELATIONS = {
    "none": (None,) * 12,
    "fb": (None, None, None, None, None, None, 0.01, 3.0, "hors med", None, None, None),
    "sih med": (None, None, None, None, None, None, 0.011, 3.0, "hors med", 1e-5, 3.0, "med"),
    "obs robust": (0.012, 3.0, "med", 50.0, 250.0, True, 0.01, 3.0, "med", 1e-5, 3.0, "med"),
    "obs weak": (0.012, 3.0, "med", 50.0, 250.0, False, 0.01, 3.0, "hors med", 1e-5, 3.1, "hors med"),
    "obs only": (0.012, 3.0, "med", 50.0, 250.0, True, None, None, None, None, None, None),
    "obs foreign": (0.012, 3.0, None, 50.0, 250.0, True, 0.01, 3.0, None, None, None, None),
    "no exponent": (24.0, None, "med", 156.0, 156.0, False, 0.003, 3.085, "hors med", 3.676e-6, 3.2, "hors med"),
}
SIZES = (None, 0.0, 10.0, 50.0, 200.0, 250.0, 260.0, 275.0, 280.0, 300.0, 301.0)
FACTORS = (None, 0.0, 0.4, 0.5, 1.0, 1.5, 2.0, 5.0, 0.0005, 0.001, 0.005, 1e5)
COUNTS = (None, 0.0, 1.0, 5.0)
LIMITS = (None, 250.0)


def test_every_branch(spark):
    rows = []
    for i, (name, size, factor, n, limit) in enumerate(
        itertools.product(RELATIONS, SIZES, FACTORS, COUNTS, LIMITS)
    ):
        grams = None if factor is None else factor * 0.01 * ((size or 100.0) / 10) ** 3
        rows.append((i, name, size, grams, n, limit))
    d = spark.createDataFrame(
        rows, f"i int, {C.SPECIES} string, {C.SIZE} double, {C.WEIGHT} double, {C.CATCHES} double, {C.SIZE_MAX} double"
    )
    coef = spark.createDataFrame([(k, *v) for k, v in RELATIONS.items()], COEFFICIENT_SCHEMA)
    got = W.correct_weights(d, coef).orderBy("i").collect()
    seen = set()
    for (_, name, size, grams, n, limit), r in zip(rows, got):
        a_o, b_o, o_o, lo, hi, robust, a_f, b_f, o_f, a_s, b_s, o_s = RELATIONS[name]

        def weight(a, b, x):
            if a is None or x is None or (b is None and x != 1):
                return None
            return a if x == 1 else a * x**b

        cm = None if size is None else size / 10
        w_o, w_f, w_s = weight(a_o, b_o, cm), weight(a_f, b_f, cm), weight(a_s, b_s, size)
        obs_ok = w_o is not None and lo <= size <= hi and robust
        ref, text, final, line = expected(size, grams, n, limit, w_s, w_f, w_o, o_s, o_f, o_o, obs_ok)
        case = (name, size, grams, n, limit)
        assert same(r[W.REFERENCE], ref), case
        assert r[W.DIAGNOSIS] == text, (case, r)
        assert same(r[C.FINAL_WEIGHT], final) and same(r[C.LINE_WEIGHT], line), (case, r)
        seen.add(text)
    # the text of a line without catch only survives between the two size margins
    assert seen == {t for _, t in W.READINGS} | {W.SIZE_ABERRANT, W.TOO_HEAVY, None}


def test_declared_weight(spark):
    d = spark.createDataFrame([(5.0,)], f"{C.WEIGHT} double")
    assert W.with_weight(d).first()[C.LINE_WEIGHT] == 5.0
    with pytest.raises(ValueError):
        W.with_weight(d, corrected=True)
