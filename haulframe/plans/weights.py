"""Declared weights checked against length-weight relations.

Up to three relations per species predict a weight from the size. One of them
is chosen, the declared weight is compared with it under four readings (total
or mean, grams or kilograms), and the reading that fits decides the weight of
the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.functions.semantics import (
    count_equal, count_present, divide, if_else3, power,
)
from haulframe.functions.text import mentions
from haulframe.operators.joins import match_missing
from haulframe.sources import columns as C

# Limits of the method.
RATIO_LOW, RATIO_HIGH = 0.5, 1.5
RATIO_SIZE_MARGIN = 1.1  # above it no ratio is formed and the weight is kept
DIAGNOSIS_SIZE_MARGIN = 1.2  # above it the size is called aberrant
HEAVIEST_G = 1_000_000
REGIONAL = "med"

# Diagnosis texts.
NO_REFERENCE = "aucun poids théorique, poids obs gardé"
SIZE_ABERRANT = "taille aberrante car > à taille max +20%, poids obs gardé"
NO_CATCH = "pas de capture"
NO_SIZE = "pas de taille, poids obs gardé"
NO_WEIGHT = "poids absent"
SINGLE_OK = "poids obs ok"
SINGLE_KG = "erreur unité : poids saisi en kg (individu)"
SINGLE_ABERRANT = "poids obs aberrant"
TOTAL_KEPT = "TOTAL GARDÉ"
MEAN_GIVEN = "poids donné moyen d'un individu"
TOTAL_KG = "TOTAL GARDÉ - erreur unité : poids saisi en kg"
ABERRANT = "poids aberrant"
TOO_HEAVY = "taille et poids aberrant, on met NA"

# Columns that the correction adds.
W_SIH, W_FB, W_OBS = "Poids_theorique_SIH", "Poids_theorique_FB", "Poids_theorique_ObsBio"
N_RELATIONS, N_REGIONAL = "nb_theo_non_na", "nb_med"
ONE_RELATION, OBS_VALID = "cas_equivalent_unique", "obs_valide"
REFERENCE, DIAGNOSIS = "poids_theo_ref", "diag_poids"
R_TOTAL, R_MEAN = "ratio_si_total", "ratio_si_moyenne"
R_TOTAL_KG, R_MEAN_KG = "ratio_si_total_kg", "ratio_si_moy_kg"


def theoretical_weights(df: DataFrame) -> DataFrame:
    """Predicted weight per relation; one of them takes millimetres."""
    mm, cm = F.col(C.SIZE), F.col(C.SIZE) / 10
    return df.withColumns({
        W_SIH: F.col("a_SIH") * power(mm, "b_SIH"),
        W_FB: F.col("a_FB") * power(cm, "b_FB"),
        W_OBS: F.col("a_obs") * power(cm, "b_obs"),
    })


def relation_facts(df: DataFrame) -> DataFrame:
    n, regional = F.col(N_RELATIONS), F.col(N_REGIONAL)
    size = F.col(C.SIZE)
    return df.withColumns({
        N_RELATIONS: count_present(W_SIH, W_FB, W_OBS),
        N_REGIONAL: count_equal(REGIONAL, "origine_SIH", "origine_FB", "origine_obs"),
    }).withColumns({
        ONE_RELATION: (n == 1) | ((n > 1) & (regional == 1)),
        OBS_VALID: F.col(W_OBS).isNotNull()
        & (size >= F.col("Taille_min_ratio"))
        & (size <= F.col("Taille_max_ratio"))
        & F.col("ratio_robuste"),
    })


def reference_weight() -> Column:
    """The relation to trust: regional ones first, in an order that depends on
    whether there is effectively one relation."""
    one, obs_ok = F.col(ONE_RELATION), F.col(OBS_VALID)

    def regional(origin: str) -> Column:
        return F.col(origin) == REGIONAL

    def first_of(*choices) -> Column:
        chain = F
        for cond, weight in choices:
            chain = chain.when(cond, F.col(weight))
        return chain

    by_order = (
        (obs_ok, W_OBS),
        (F.col(W_FB).isNotNull(), W_FB),
        (F.col(W_SIH).isNotNull(), W_SIH),
    )
    single = first_of(
        (regional("origine_SIH"), W_SIH),
        (regional("origine_FB"), W_FB),
        *by_order,
    )
    several = first_of(
        (regional("origine_obs") & obs_ok, W_OBS),
        (regional("origine_FB"), W_FB),
        (regional("origine_SIH"), W_SIH),
        *by_order,
    )
    return F.when(one, single).otherwise(several)


def ratio_hypotheses(df: DataFrame) -> DataFrame:
    """Declared over predicted weight under the four readings."""
    usable = F.col(C.SIZE) < F.col(C.SIZE_MAX) * RATIO_SIZE_MARGIN
    grams = F.col(C.WEIGHT)

    def ratio(weight: Column) -> Column:
        return F.when(usable, divide(weight, REFERENCE))

    return df.withColumns({
        R_TOTAL: ratio(divide(grams, C.CATCHES)),
        R_MEAN: ratio(grams),
        R_TOTAL_KG: ratio(divide(grams * 1000, C.CATCHES)),
        R_MEAN_KG: ratio(grams * 1000),
    })


# Readings of a declared weight, in the order in which they are tried.
READINGS = (
    (UNKNOWN := "no reference", NO_REFERENCE),
    (NONE_CAUGHT := "none caught", NO_CATCH),
    (UNSIZED := "unsized", NO_SIZE),
    (UNWEIGHED := "unweighed", NO_WEIGHT),
    (ONE_G := "one fish, g", SINGLE_OK),
    (ONE_KG := "one fish, kg", SINGLE_KG),
    (ONE_OFF := "one fish, off", SINGLE_ABERRANT),
    (ALL_G := "all fish, g", TOTAL_KEPT),
    (EACH_G := "each fish, g", MEAN_GIVEN),
    (ALL_KG := "all fish, kg", TOTAL_KG),
    (EACH_KG := "each fish, kg", SINGLE_KG),
    (OFF := "off", ABERRANT),
)
READING = "_reading"
_CODES = {name: code for code, (name, _) in enumerate(READINGS, 1)}


def _is(*names: str) -> Column:
    return F.col(READING).isin([_CODES[n] for n in names])


def reading() -> Column:
    """Which reading explains the declared weight, as a position in READINGS.

    Both the diagnosis and the final weight follow from it. Deciding it once
    keeps the generated code small enough to be compiled to machine code.
    """
    n = F.col(C.CATCHES)

    def fits(ratio: str) -> Column:
        return F.col(ratio).between(RATIO_LOW, RATIO_HIGH)

    def code(name: str) -> Column:
        return F.lit(_CODES[name])

    one = F.when(fits(R_MEAN), code(ONE_G)).when(fits(R_MEAN_KG), code(ONE_KG)).otherwise(code(ONE_OFF))
    several = (
        F.when(fits(R_TOTAL), code(ALL_G))
        .when(fits(R_MEAN), code(EACH_G))
        .when(fits(R_TOTAL_KG), code(ALL_KG))
        .when(fits(R_MEAN_KG), code(EACH_KG))
        .otherwise(code(OFF))
    )
    return (
        F.when(F.col(REFERENCE).isNull(), code(UNKNOWN))
        .when(n == 0, code(NONE_CAUGHT))
        .when(F.col(C.SIZE) == 0, code(UNSIZED))
        .when(F.col(C.WEIGHT) == 0, code(UNWEIGHED))
        .when(n == 1, one)
        .when(n > 1, several)
        .otherwise(code(OFF))
    )


def _size_over(margin: float) -> Column:
    return F.coalesce(F.col(C.SIZE) > F.col(C.SIZE_MAX) * margin, F.lit(False))


def diagnosis() -> Column:
    """Text of the reading; an impossible size goes before all but the lack of
    a reference."""
    texts = F.array(*(F.lit(text) for _, text in READINGS))
    return F.when(
        _size_over(DIAGNOSIS_SIZE_MARGIN) & ~_is(UNKNOWN), F.lit(SIZE_ABERRANT)
    ).otherwise(F.element_at(texts, F.col(READING)))


def final_weight() -> Column:
    """Declared grams, declared kilograms as grams, or the predicted weight."""
    grams = F.col(C.WEIGHT)
    return (
        F.when(_is(UNKNOWN) | _size_over(RATIO_SIZE_MARGIN), grams)
        .when(_is(NONE_CAUGHT), F.lit(None).cast("double"))
        .when(_is(UNSIZED, ONE_G, ALL_G, EACH_G), grams)
        .when(_is(ONE_KG, ALL_KG, EACH_KG), grams * 1000)
        .otherwise(F.col(REFERENCE))
    )


def drop_impossible(df: DataFrame) -> DataFrame:
    """Weights above the limit become missing; a line without a weight loses
    its diagnosis."""
    too_heavy = F.col(C.FINAL_WEIGHT) > HEAVIEST_G
    return df.withColumns({
        DIAGNOSIS: if_else3(too_heavy, F.lit(TOO_HEAVY), F.col(DIAGNOSIS)),
        C.FINAL_WEIGHT: if_else3(too_heavy, F.lit(None).cast("double"), F.col(C.FINAL_WEIGHT)),
    })


def line_weight() -> Column:
    """Weight of the whole line: already a total, or per fish times the count."""
    final = F.col(C.FINAL_WEIGHT)
    is_total = mentions(DIAGNOSIS, TOTAL_KEPT)
    as_declared = mentions(DIAGNOSIS, NO_REFERENCE) | mentions(DIAGNOSIS, NO_SIZE)
    return (
        F.when(is_total | as_declared, final)
        .when(final.isNotNull(), final * F.col(C.CATCHES))
    )


def with_coefficients(df: DataFrame, coefficients: DataFrame) -> DataFrame:
    return match_missing(df, coefficients.drop(C.ROW_ID), [C.SPECIES])


def correct_weights(df: DataFrame, coefficients: DataFrame) -> DataFrame:
    df = relation_facts(theoretical_weights(with_coefficients(df, coefficients)))
    df = ratio_hypotheses(df.withColumn(REFERENCE, reference_weight()))
    df = df.withColumn(READING, reading())
    df = df.withColumns({DIAGNOSIS: diagnosis(), C.FINAL_WEIGHT: final_weight()}).drop(READING)
    return drop_impossible(df).withColumn(C.LINE_WEIGHT, line_weight())


def with_weight(
    df: DataFrame, coefficients: DataFrame | None = None, corrected: bool = False
) -> DataFrame:
    """Add the weight of each line: corrected, or as declared."""
    if not corrected:
        return df.withColumn(C.LINE_WEIGHT, F.col(C.WEIGHT))
    if coefficients is None:
        raise ValueError("the weight correction needs the coefficient table")
    return correct_weights(df, coefficients)
