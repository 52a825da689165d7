"""The SQL twin of every query, written for DuckDB over the supplied tables.

Named steps are put in front of a query as common table expressions, in the order their texts need each other.
"""

from __future__ import annotations

import re
from functools import cache

from cohortspark import constants as k

NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
# Multipliers and key factors of the controls' preference order.
SCRAMBLE = ((668_265, 374_761, 15_731), (524_309, 789_221, 48_271), (907_633, 126_613, 69_069))
FLAGS = (*k.COMORBIDITIES, "cdis1", *k.DRUG_FLAGS)
MODEL = ("allo", *FLAGS)


def number(text: str) -> str:
    return f"TRY_CAST(CASE WHEN regexp_matches({text}, {NUMBER}) THEN {text} END AS DOUBLE)"


def ids(values) -> str:
    return "(" + ", ".join(str(v) for v in values) + ")"


def birthdays(start: str, end: str) -> str:
    return (f"CAST(year({end}) - year({start}) - CASE WHEN month({end}) * 100 + day({end}) < "
            f"month({start}) * 100 + day({start}) THEN 1 ELSE 0 END AS INT)")


def scrambled() -> str:
    """The candidate that each turn of a case names, as ``x3``: the arithmetic of the preference order."""
    text = """SELECT case_number, total, length(bin(total - 1)) AS bits, (1::BIGINT << length(bin(total - 1))) - 1 AS mask,
        unnest(range(1::BIGINT << length(bin(total - 1)))) AS turn, turn AS x0
        FROM (SELECT DISTINCT case_number, total FROM pairs)"""
    for step, (times, of_case, of_seed) in enumerate(SCRAMBLE, start=1):
        text = (f"SELECT *, xor(y{step}, y{step} >> (1 + bits // 2)) AS x{step} FROM (SELECT *, (x{step - 1} * {times} "
                f"+ case_number * {of_case} + 42 * {of_seed}) & mask AS y{step} FROM ({text}))")
    return text


STRIPPED = number("regexp_replace(value_source_value, '[^0-9.-]', '', 'g')")
SHIPPED = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
CLASS_CASE = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(k.DRUG_CLASSES))
SURGERY = " OR ".join(f"procedure_source_value LIKE '%{p}%'" for p in k.SURGERY_PATTERNS)
LOOKBACK = "BETWEEN indexdt2 - 180 AND indexdt2 - 1"
DRUG_DAYS = "CAST(drug_exposure_start_date + days_supply - 1 AS DATE)"

STEPS: dict[str, str] = {
    # ---- clinical tables and code lists
    "ids200": "SELECT range AS id FROM range(200)",
    "person": """SELECT c_custkey AS person_id,
        CAST(CASE WHEN c_custkey % 53 = 0 THEN NULL WHEN c_custkey % 6 < 3 THEN 8507 ELSE 8532 END AS BIGINT) AS gender_concept_id,
        CAST(1930 + (c_custkey * 7) % 70 AS INT) AS year_of_birth,
        CAST(CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN 13 ELSE 1 + c_custkey % 12 END AS INT) AS month_of_birth, CAST(1 + c_custkey % 28 AS INT) AS day_of_birth
        FROM customer""",
    "measurement": """SELECT o_orderkey AS measurement_id, o_custkey AS person_id,
        CAST(CASE WHEN o_orderkey % 10 < 6 THEN 1001 + o_orderkey % 2 WHEN o_orderkey % 10 < 8 THEN 3010340
             WHEN o_orderkey % 10 = 8 THEN 3016451 ELSE 3008486 END AS BIGINT) AS measurement_concept_id,
        CAST(o_orderdate AS DATE) AS measurement_date,
        CASE WHEN u = 999 THEN '<0.01' WHEN u = 998 THEN NULL
             ELSE concat(CAST(CAST(floor(q / 100.0) AS BIGINT) AS STRING), '.',
                         lpad(CAST(q % 100 AS STRING), 2, '0'), ' uIU/mL') END AS value_source_value
        FROM (SELECT *, CASE WHEN u < 30 THEN 460 + u * 10 WHEN u < 40 THEN u - 20
                             ELSE 50 + (u * 13) % 400 END AS q
              FROM (SELECT *, (o_orderkey * 7919 + 104729) % 1000 AS u FROM orders))""",
    "drug_exposure": f"""SELECT l_orderkey * 10 + l_linenumber AS drug_exposure_id, o_custkey AS person_id,
        l_partkey % 200 AS drug_concept_id, CAST(l_shipdate AS DATE) AS drug_exposure_start_date,
        CAST(CASE WHEN l_orderkey % 37 = 0 THEN NULL WHEN l_orderkey % 41 = 0 OR l_partkey % 200 = 5
             AND l_orderkey % 3 = 0 THEN CAST(l_shipdate AS DATE) + 700
             ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity + l_orderkey % 5 AS INT) - 1 END AS DATE) AS drug_exposure_end_date,
        CAST(l_quantity AS INT) AS days_supply {SHIPPED}""",
    "condition_occurrence": f"""SELECT o_custkey AS person_id,
        (l_orderkey * 31 + l_linenumber * 17) % 200 AS condition_concept_id,
        CASE WHEN l_orderkey % 43 <> 0 THEN CAST(l_shipdate AS DATE) END AS condition_start_date {SHIPPED}""",
    "procedure_occurrence": f"""SELECT o_custkey AS person_id,
        CASE WHEN l_orderkey % 101 = 0 THEN 4036252 ELSE 10000 + l_suppkey END AS procedure_concept_id,
        CAST(l_shipdate AS DATE) AS procedure_date,
        CASE WHEN l_orderkey % 89 = 0 THEN concat('KP455', CAST(1 + l_orderkey % 4 AS STRING), '0')
             ELSE concat('M', CAST(l_orderkey % 1000 AS STRING)) END AS procedure_source_value {SHIPPED}""",
    "concept_relationship": """SELECT c AS concept_id_1, 500000 + c * 10 + j AS concept_id_2,
        CASE WHEN j < 2 THEN 'Mapped from' ELSE 'Maps to' END AS relationship_id
        FROM (SELECT id AS c FROM ids200) CROSS JOIN (SELECT id AS j FROM ids200 WHERE id < 3)""",
    "concept": """SELECT 500000 + c * 10 + j AS concept_id,
        concat('dx ', CAST(c AS STRING), '/', CAST(j AS STRING)) AS concept_name,
        CASE WHEN j < 2 THEN 'ICD10CM' ELSE 'SNOMED' END AS vocabulary_id,
        concat(chr(CAST(65 + (c * 5 + j) % 26 AS INT)), lpad(CAST((c * 7) % 100 AS STRING), 2, '0'), '.',
               CAST(j AS STRING)) AS concept_code
        FROM (SELECT id AS c FROM ids200) CROSS JOIN (SELECT id AS j FROM ids200 WHERE id < 3)
        UNION ALL
        SELECT 600000 + l * 100 + n, concat('block ', CAST(l AS STRING), '-', CAST(n AS STRING)), 'ICD10CM',
        concat(chr(CAST(65 + l AS INT)), lpad(CAST(n AS STRING), 2, '0'))
        FROM (SELECT id AS l FROM ids200 WHERE id < 26) CROSS JOIN (SELECT id AS n FROM ids200 WHERE id < 100)""",
    "tsh_codes": "SELECT CAST(id AS BIGINT) AS concept_id FROM (VALUES (1001), (1002)) t(id)",
    "target_drug_codes": "SELECT id AS concept_id FROM ids200 WHERE id % 20 < 4 AND id <> 5",
    "excl_condition_codes": "SELECT id AS concept_id FROM ids200 WHERE id = 3",
    "excl_drug_codes": "SELECT id AS concept_id FROM ids200 WHERE id = 5",
    "cov_drug_codes": f"""SELECT id AS concept_id, CASE (id * 7) % 19 {CLASS_CASE} ELSE 'other' END AS drname
        FROM ids200 WHERE id % 20 >= 4 AND id <> 5""",
    "cov_condition_codes": """SELECT id AS concept_id, CASE WHEN id % 3 = 0 THEN NULL ELSE 1 END AS dis1
        FROM ids200 WHERE id % 29 = 4""",
    "cci_codes": "SELECT id AS concept_id, " + ", ".join(
        f"CASE WHEN id % 23 = {j - 1} THEN 1 WHEN (id + {j}) % 5 = 0 THEN NULL ELSE 0 END AS CCI{j}"
        for j in range(1, 18)) + " FROM ids200 WHERE id % 23 < 17",
    "titles": "SELECT * FROM (VALUES " + ", ".join(
        f"({n}, '{a}~{b}', '{title}', '{korean}')" for n, a, b, title, korean in k.ICD_CHAPTERS)
        + ") t(Chapter, Block, Title, K_title)",
    "ranges": "SELECT * FROM (VALUES " + ", ".join(
        f"({n}, '{a}', '{b}')" for n, a, b, *_ in k.ICD_CHAPTERS) + ") t(Chapter, first_code, last_code)",
    "letters": "SELECT * FROM (VALUES " + ", ".join(
        f"('{letter}', {0 if low is None else low}, {99 if high is None else high}, {chapter})"
        for letter, low, high, chapter in k.CHAPTER_LETTERS) + ") t(letter, low, high, Chapter)",
    # ---- cohort
    "labs": f"""SELECT person_id, measurement_id, measurement_concept_id, measurement_date, value
        FROM (SELECT *, {number("split_part(value_source_value, ' ', 1)")} AS value FROM measurement
              WHERE measurement_concept_id IN (SELECT concept_id FROM tsh_codes)) WHERE value IS NOT NULL""",
    "entry": "SELECT person_id, min(measurement_date) AS enroll_date FROM labs GROUP BY person_id",
    "births": """SELECT person_id, gender_concept_id, make_date(year_of_birth, CASE WHEN month_of_birth <= 12 THEN month_of_birth END, day_of_birth) AS birth
        FROM person""",
    "adult": """SELECT * FROM (SELECT person_id, enroll_date, birth, gender_concept_id,
        (enroll_date - birth) / 365.25 AS age FROM entry JOIN births USING (person_id)) WHERE age >= 19""",
    "stage4": """SELECT * FROM adult a WHERE NOT EXISTS (SELECT 1 FROM labs e WHERE e.person_id = a.person_id
        AND e.measurement_date <= a.enroll_date + 364 AND (e.value > 4.5 OR e.value < 0.5))""",
    "stage5": """SELECT * FROM stage4 a WHERE NOT EXISTS (SELECT 1 FROM condition_occurrence e
        WHERE e.person_id = a.person_id AND e.condition_start_date <= a.enroll_date + 364
        AND e.condition_concept_id IN (SELECT concept_id FROM excl_condition_codes))""",
    "stage6": f"""SELECT * FROM stage5 a WHERE NOT EXISTS (SELECT 1 FROM procedure_occurrence e
        WHERE e.person_id = a.person_id AND e.procedure_date <= a.enroll_date + 364 AND ({SURGERY}))""",
    "stage7": """SELECT * FROM stage6 a WHERE NOT EXISTS (SELECT 1 FROM drug_exposure e
        WHERE e.person_id = a.person_id AND e.drug_concept_id IN (SELECT concept_id FROM excl_drug_codes)
        AND (e.drug_exposure_start_date BETWEEN a.enroll_date AND a.enroll_date + 364
             OR e.drug_exposure_end_date BETWEEN a.enroll_date AND a.enroll_date + 364))""",
    "stage8": f"""SELECT * FROM stage7 a WHERE NOT EXISTS (SELECT 1 FROM procedure_occurrence e
        WHERE e.person_id = a.person_id AND e.procedure_date <= a.enroll_date + 364
        AND e.procedure_concept_id IN {ids(k.RADIOIODINE_CODES)})""",
    "cases": f"""SELECT row_number() OVER (ORDER BY person_id) AS case_number, person_id, enroll_date, indexdt, birth,
        {birthdays("birth", "indexdt")} AS age, value, gender_concept_id
        FROM stage8 JOIN (SELECT person_id, measurement_date AS indexdt, value, row_number() OVER (
            PARTITION BY person_id ORDER BY measurement_date, measurement_id) AS rn FROM labs WHERE value > 4.5)
        USING (person_id) WHERE rn = 1""",
    "pool": """SELECT person_id, enroll_date, gender_concept_id, CAST(floor(age) AS INT) AS age FROM stage8
        WHERE person_id NOT IN (SELECT person_id FROM cases)""",
    "pairs": """SELECT c.case_number, p.person_id, row_number() OVER (PARTITION BY c.case_number
        ORDER BY p.age, p.enroll_date, p.person_id % 256, p.person_id) - 1 AS number,
        count(*) OVER (PARTITION BY c.case_number) AS total
        FROM cases c JOIN pool p ON p.gender_concept_id = c.gender_concept_id
        AND p.age BETWEEN c.age - 5 AND c.age + 5
        AND p.enroll_date BETWEEN c.enroll_date - 30 AND c.enroll_date + 30""",
    "preferences": """SELECT case_number, turn, CAST(x3 AS BIGINT) AS number FROM (""" + scrambled() + ") WHERE x3 < total",
    "lists": """SELECT c.case_number, coalesce(l.people, []::BIGINT[]) AS people FROM cases c LEFT JOIN
        (SELECT case_number, list(person_id ORDER BY turn) AS people FROM pairs JOIN preferences USING (case_number, number)
         GROUP BY case_number) l USING (case_number)""",
    "picks": """SELECT CAST(0 AS BIGINT) AS case_number, []::BIGINT[] AS taken, []::BIGINT[] AS got
        UNION ALL
        SELECT case_number, list_concat(taken, got), got FROM (
            SELECT l.case_number, p.taken,
                   list_slice(list_filter(l.people, lambda x: NOT list_contains(p.taken, x)), 1, 4) AS got
            FROM picks p JOIN lists l ON l.case_number = p.case_number + 1)""",
    "matches": "SELECT case_number, unnest(got) AS person_id FROM picks",
    "case_control": """SELECT person_id, enroll_date, age, gender_concept_id, value, 1 AS TSH, case_number,
        indexdt AS indexdt2 FROM cases
        UNION ALL
        SELECT m.person_id, p.enroll_date, p.age, p.gender_concept_id, NULL, 0, m.case_number, c.indexdt
        FROM matches m JOIN cases c USING (case_number) JOIN pool p ON p.person_id = m.person_id""",
    # ---- exposure and covariates
    "target_drugs": """SELECT * FROM drug_exposure
        WHERE drug_concept_id IN (SELECT concept_id FROM target_drug_codes)""",
    "taken_rows": f"""SELECT person_id, case_number, indexdt2, drug_concept_id, drug_exposure_start_date,
        {DRUG_DAYS} AS drug_end_date, days_supply
        FROM case_control JOIN target_drugs USING (person_id)
        WHERE drug_exposure_start_date {LOOKBACK} OR {DRUG_DAYS} {LOOKBACK}""",
    "exposures": """SELECT DISTINCT person_id, case_number, indexdt2, drug_exposure_start_date, drug_end_date,
        days_supply,
        CASE WHEN drug_exposure_start_date < indexdt2 - 180 THEN CAST(indexdt2 - 180 AS DATE)
             ELSE drug_exposure_start_date END AS drug_exposure_start_date2,
        CASE WHEN drug_end_date >= indexdt2 THEN CAST(indexdt2 - 1 AS DATE) ELSE drug_end_date END AS drug_end_date2
        FROM taken_rows""",
    "recency": "SELECT person_id, case_number, 1 AS allo, min(w) AS w FROM (SELECT *, CASE " + " ".join(
        f"WHEN drug_exposure_start_date2 BETWEEN indexdt2 - {far} AND indexdt2 - {near + 1} "
        f"OR drug_end_date2 BETWEEN indexdt2 - {far} AND indexdt2 - {near + 1} THEN {i}"
        for i, (near, far) in enumerate(((0, 30), (30, 60), (60, 90), (90, 180)), start=1))
        + " END AS w FROM exposures) GROUP BY person_id, case_number",
    "gaps": """SELECT *, CAST(drug_end_date2 - lag(drug_exposure_start_date2) OVER (
        PARTITION BY person_id, case_number ORDER BY drug_exposure_start_date2, drug_end_date2) AS INT) AS cwc
        FROM exposures""",
    "dose": """SELECT person_id, case_number,
        CAST(max(drug_end_date2) - min(drug_exposure_start_date2) + 1 AS INT) AS drugday
        FROM (SELECT *, sum(CASE WHEN cwc > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY person_id, case_number
              ORDER BY drug_exposure_start_date2, drug_end_date2 ROWS UNBOUNDED PRECEDING) AS breaks FROM gaps)
        WHERE breaks = 0 GROUP BY person_id, case_number""",
    "recent_conditions": f"""SELECT person_id, case_number, condition_concept_id, condition_start_date
        FROM case_control JOIN condition_occurrence USING (person_id) WHERE condition_start_date {LOOKBACK}""",
    "cci": "SELECT person_id, case_number, " + ", ".join(
        f"max(coalesce({c}, 0)) AS {c}" for c in k.COMORBIDITIES)
        + " FROM recent_conditions JOIN cci_codes ON condition_concept_id = concept_id GROUP BY person_id, case_number",
    "cdis": """SELECT person_id, case_number, max(coalesce(dis1, 0)) AS cdis1
        FROM recent_conditions JOIN cov_condition_codes ON condition_concept_id = concept_id
        GROUP BY person_id, case_number""",
    "cdr": "SELECT person_id, case_number, " + ", ".join(
        f"max(CASE WHEN drname = '{c}' THEN 1 ELSE 0 END) AS cdr{i}" for i, c in enumerate(k.DRUG_CLASSES, 1))
        + f""" FROM case_control JOIN drug_exposure USING (person_id) JOIN cov_drug_codes ON drug_concept_id = concept_id
        WHERE drug_exposure_start_date {LOOKBACK} OR {DRUG_DAYS} {LOOKBACK} GROUP BY person_id, case_number""",
    "analysis": "SELECT b.*, coalesce(allo, 0) AS allo, coalesce(w, 0) AS w, drugday, " + ", ".join(
        f"coalesce({c}, 0) AS {c}" for c in FLAGS) + """,
        CASE WHEN age BETWEEN 19 AND 29 THEN 1 WHEN age BETWEEN 30 AND 39 THEN 2 WHEN age BETWEEN 40 AND 49 THEN 3
             WHEN age BETWEEN 50 AND 59 THEN 4 WHEN age BETWEEN 60 AND 69 THEN 5 WHEN age BETWEEN 70 AND 79 THEN 6
             ELSE 7 END AS agegr, CAST(year(enroll_date) AS INT) AS enrollyear
        FROM case_control b LEFT JOIN recency USING (person_id, case_number)
        LEFT JOIN dose USING (person_id, case_number) LEFT JOIN cci USING (person_id, case_number)
        LEFT JOIN cdis USING (person_id, case_number) LEFT JOIN cdr USING (person_id, case_number)""",
    "scored": """SELECT * REPLACE (CASE WHEN gender_concept_id = 8507 THEN 1 WHEN gender_concept_id <> 8507 THEN 0 END AS gender_concept_id),
        CASE WHEN CCI < 1 THEN 1 WHEN CCI < 2 THEN 2 WHEN CCI < 3 THEN 3 ELSE 4 END AS CCIGR
        FROM (SELECT *, CCI6 + CCI7 + CCI11 + CCI13 + 2 * (CCI2 + CCI5 + CCI9 + CCI12 + CCI14)
                        + 4 * (CCI15 + CCI7) + 6 * CCI16 AS CCI FROM analysis)""",
    "freq": "SELECT variable, value, control + patient AS total, control, "
        "control / (control + patient) AS control_ratio, patient, patient / (control + patient) AS patient_ratio "
        "FROM (" + " UNION ALL ".join(
            f"SELECT '{v}' AS variable, CAST({v} AS STRING) AS value, count(*) FILTER (TSH = 0) AS control, "
            f"count(*) FILTER (TSH = 1) AS patient FROM scored WHERE {v} IS NOT NULL GROUP BY {v}" for v in k.TABLE_VARIABLES) + ")",
    "model_variables": f"""SELECT DISTINCT variable FROM freq WHERE value = '1' AND control <> 0 AND patient <> 0
        AND variable NOT IN ({", ".join(f"'{v}'" for v in k.NOT_MODELLED)})""",
    # ---- models
    "strata": " UNION ALL ".join(
        f"SELECT '{v}' AS variable, count(*) AS m, sum({v}) AS e, sum({v} * TSH) AS d FROM scored "
        "GROUP BY case_number" for v in MODEL),
    "histogram": """SELECT variable, CAST(m AS DOUBLE) AS m, CAST(e AS DOUBLE) AS e, CAST(d AS DOUBLE) AS d,
        CAST(count(*) AS DOUBLE) AS n FROM strata WHERE e > 0 AND e < m
        AND variable IN (SELECT variable FROM model_variables) GROUP BY ALL""",
    "newton": """SELECT DISTINCT variable, 0 AS it, CAST(0 AS DOUBLE) AS beta, CAST(1 AS DOUBLE) AS step,
        CAST(1 AS DOUBLE) AS info FROM histogram
        UNION ALL
        SELECT variable, it + 1, beta + u / info, u / info, info FROM (
            SELECT variable, it, beta, sum(n * (d - q)) AS u, sum(n * q * (1 - q)) AS info FROM (
                SELECT s.variable, s.it, s.beta, h.n, h.d, h.e * exp(s.beta) / (h.e * exp(s.beta) + h.m - h.e) AS q
                FROM newton s JOIN histogram h USING (variable) WHERE s.it < 20 AND abs(s.beta) < 500)
            GROUP BY variable, it, beta) WHERE info >= 1e-9""",
    "fits": """SELECT variable, beta AS estimate, 1 / sqrt(info) AS std_error, beta * sqrt(info) AS statistic
        FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY it) AS rn FROM newton
              WHERE it > 0 AND abs(step) <= 1e-9 * greatest(1, abs(beta))) WHERE rn = 1""",
    "simpson": """SELECT range AS i, CASE WHEN range IN (0, 400) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS weight
        FROM range(401)""",
    "p_values": """SELECT variable, 1 - 2 * sum(weight * exp(-0.5 * pow(statistic * i / 400, 2)))
        * abs(statistic) / 1200 / sqrt(2 * pi()) AS p_value FROM fits CROSS JOIN simpson GROUP BY variable, statistic""",
    "crude": """SELECT v.variable, '1' AS level, exp(estimate) AS OR_, exp(estimate - 1.96 * std_error) AS lower_ci,
        exp(estimate + 1.96 * std_error) AS upper_ci, estimate, std_error, statistic, p_value,
        estimate IS NOT NULL AS converged FROM model_variables v LEFT JOIN fits USING (variable)
        LEFT JOIN p_values USING (variable)""",
    # The same models of strata with many cases: the exposed ones among them are noncentral hypergeometric.
    "pooled_strata": " UNION ALL ".join(
        f"SELECT '{v}' AS variable, count(*) AS m, sum(TSH) AS k, sum({v}) AS e, sum({v} * TSH) AS d FROM scored "
        "GROUP BY gender_concept_id, agegr, enrollyear" for v in MODEL),
    "pooled_histogram": """SELECT *, row_number() OVER () AS id FROM (
            SELECT variable, CAST(m AS BIGINT) AS m, CAST(k AS BIGINT) AS k, CAST(e AS BIGINT) AS e, CAST(d AS BIGINT) AS d, count(*) AS n
            FROM pooled_strata WHERE k > 0 AND k < m AND e > 0 AND e < m AND variable IN (SELECT variable FROM model_variables) GROUP BY ALL)""",
    "pooled_support": """SELECT *, base - max(base) OVER (PARTITION BY id) AS weight FROM (
            SELECT *, lgamma(e + 1) - lgamma(x + 1) - lgamma(e - x + 1) + lgamma(m - e + 1) - lgamma(k - x + 1) - lgamma(m - e - k + x + 1) AS base
            FROM (SELECT *, unnest(range(greatest(0, k - m + e), least(k, e) + 1)) AS x FROM pooled_histogram))""",
    "pooled_newton": """SELECT DISTINCT variable, 0 AS it, CAST(0 AS DOUBLE) AS beta, CAST(1 AS DOUBLE) AS step,
        CAST(1 AS DOUBLE) AS info FROM pooled_histogram
        UNION ALL
        SELECT variable, it + 1, beta + u / info, u / info, info FROM (
            SELECT variable, it, beta, sum(n * (d - mean)) AS u, sum(n * spread) AS info FROM (
                SELECT variable, it, beta, id, n, d, sum(w * x) / sum(w) AS mean, sum(w * x * x) / sum(w) - pow(sum(w * x) / sum(w), 2) AS spread
                FROM (SELECT s.variable, s.it, s.beta, h.id, h.n, h.d, h.x, exp(h.weight + h.x * s.beta) AS w
                      FROM pooled_newton s JOIN pooled_support h USING (variable) WHERE s.it < 20 AND abs(s.beta) < 500)
                GROUP BY variable, it, beta, id, n, d)
            GROUP BY variable, it, beta) WHERE info >= 1e-9""",
    "pooled_fits": """SELECT variable, beta AS estimate, 1 / sqrt(info) AS std_error, beta * sqrt(info) AS statistic
        FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY it) AS rn FROM pooled_newton
              WHERE it > 0 AND abs(step) <= 1e-9 * greatest(1, abs(beta))) WHERE rn = 1""",
    "pooled_p": """SELECT variable, 1 - 2 * sum(weight * exp(-0.5 * pow(statistic * i / 400, 2)))
        * abs(statistic) / 1200 / sqrt(2 * pi()) AS p_value FROM pooled_fits CROSS JOIN simpson GROUP BY variable, statistic""",
    "pooled_crude": """SELECT v.variable, '1' AS level, exp(estimate) AS OR_, exp(estimate - 1.96 * std_error) AS lower_ci,
        exp(estimate + 1.96 * std_error) AS upper_ci, estimate, std_error, statistic, p_value,
        estimate IS NOT NULL AS converged FROM model_variables v LEFT JOIN pooled_fits USING (variable)
        LEFT JOIN pooled_p USING (variable)""",
    # One model of all variables: a Newton step per turn of the recursion. Members are differences from their case, the
    # matrix is [information | score | identity], and list_reduce does one Gauss-Jordan pivot per variable.
    "members": "SELECT case_number, row_number() OVER () AS member, TSH, ["
        + ", ".join(f"CAST({v} AS DOUBLE) * (SELECT count(*) FROM model_variables WHERE variable = '{v}')" for v in MODEL) + "] AS x FROM scored",
    "differences": """SELECT case_number, r.member, list_transform(list_zip(r.x, c.x), lambda p: p[1] - p[2]) AS z
        FROM members r JOIN members c USING (case_number) WHERE c.TSH = 1""",
    "unused": "SELECT [" + ", ".join(f"CASE WHEN EXISTS (SELECT 1 FROM model_variables WHERE variable = '{v}') THEN 0.0::DOUBLE ELSE 1 END"
                                     for v in MODEL) + "] AS unit FROM range(1)",
    "joint": f"""SELECT 0 AS it, list_transform(range({len(MODEL)}), lambda i: 0.0::DOUBLE) AS beta, []::DOUBLE[] AS variance
        UNION ALL
        SELECT it + 1, list_transform(list_zip(beta, inverse), lambda p: p[1] + p[2][{len(MODEL) + 1}]),
               list_transform(inverse, lambda r, k: r[{len(MODEL) + 1} + k])
        FROM (SELECT it, beta, list_reduce(list_prepend(list(line ORDER BY k), list_transform(range({len(MODEL)}), lambda i: NULL::DOUBLE[][])),
                  lambda a, b, i: list_transform(a, lambda r, j: list_transform(r, lambda v, c:
                      CASE WHEN j = i - 1 THEN v / a[i - 1][i - 1] ELSE v - r[i - 1] * a[i - 1][c] / a[i - 1][i - 1] END))) AS inverse
              FROM (SELECT it, beta, k, list_concat(list(v + CASE WHEN l = k THEN unit[k] ELSE 0 END ORDER BY l),
                        list_transform(range(1, {len(MODEL) + 1}), lambda c: CASE WHEN c = k THEN 1.0::DOUBLE ELSE 0 END)) AS line
                    FROM (SELECT it, beta, unit, k, l, sum(q * CASE WHEN l > {len(MODEL)} THEN -z[k] ELSE d[k] * d[l] END) AS v
                          FROM (SELECT it, beta, case_number, member, q, list(zk ORDER BY k) AS z, list(dk ORDER BY k) AS d
                                FROM (SELECT *, zk - sum(q * zk) OVER (PARTITION BY case_number, k) AS dk
                                      FROM (SELECT it, beta, case_number, member, q, unnest(range(1, {len(MODEL) + 1})) AS k, unnest(z) AS zk
                                            FROM (SELECT *, w / sum(w) OVER (PARTITION BY case_number) AS q
                                                  FROM (SELECT it, beta, case_number, member, z, exp(list_dot_product(beta, z)) AS w
                                                        FROM joint CROSS JOIN differences WHERE it < 12))))
                                GROUP BY it, beta, case_number, member, q)
                          CROSS JOIN unused CROSS JOIN (SELECT unnest(range(1, {len(MODEL) + 1})) AS k) CROSS JOIN (SELECT unnest(range(1, {len(MODEL) + 2})) AS l)
                          GROUP BY it, beta, unit, k, l)
                    GROUP BY it, beta, unit, k)
              GROUP BY it, beta)""",
    "joint_fits": "SELECT variable, beta[k] AS estimate, sqrt(variance[k]) AS std_error, beta[k] / sqrt(variance[k]) AS statistic "
        "FROM joint CROSS JOIN (VALUES " + ", ".join(f"('{v}', {i})" for i, v in enumerate(MODEL, start=1)) + """) t(variable, k)
        WHERE it = 12 AND variable IN (SELECT variable FROM model_variables)""",
    "joint_p_values": """SELECT variable, 1 - 2 * sum(weight * exp(-0.5 * pow(statistic * i / 400, 2)))
        * abs(statistic) / 1200 / sqrt(2 * pi()) AS p_value FROM joint_fits CROSS JOIN simpson GROUP BY variable, statistic""",
    # ---- follow-up
    "exposed": """SELECT person_id, case_number, enroll_date, indexdt2 AS index_date FROM analysis
        WHERE value IS NOT NULL AND allo = 1""",
    "eras": """SELECT person_id, min(drug_exposure_start_date) AS start_date, CASE WHEN count(*) = count(drug_exposure_end_date) THEN max(drug_exposure_end_date) END AS last_intake,
        CAST(CASE WHEN count(*) = count(drug_exposure_end_date) THEN max(drug_exposure_end_date) END
             - min(drug_exposure_start_date) AS INT) AS drug_days
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY person_id
                  ORDER BY drug_exposure_start_date, drug_exposure_end_date, drug_exposure_id, days_supply
                  ROWS UNBOUNDED PRECEDING) AS era
              FROM (SELECT *, CASE WHEN drug_exposure_start_date <= lag(drug_exposure_end_date) OVER (
                        PARTITION BY person_id ORDER BY drug_exposure_start_date, drug_exposure_end_date,
                        drug_exposure_id, days_supply) + 7 THEN 0 ELSE 1 END AS fresh FROM target_drugs))
        GROUP BY person_id, era""",
    "eras_max": """SELECT person_id, min(s) AS start_date, CASE WHEN count(*) = count(e) THEN max(e) END AS last_intake,
        CAST(CASE WHEN count(*) = count(e) THEN max(e) END - min(s) AS INT) AS drug_days
        FROM (SELECT *, sum(fresh) OVER (PARTITION BY person_id ORDER BY s, e, drug_exposure_id
                  ROWS UNBOUNDED PRECEDING) AS era
              FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY person_id ORDER BY s, e, drug_exposure_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 7 THEN 0 ELSE 1 END AS fresh
                    FROM (SELECT person_id, drug_exposure_id, drug_exposure_start_date AS s,
                                 drug_exposure_end_date AS e FROM target_drugs)))
        GROUP BY person_id, era""",
    "near_eras": """SELECT person_id, start_date, last_intake, drug_days, enroll_date, index_date
        FROM eras JOIN exposed USING (person_id) WHERE last_intake > index_date - 180""",
    "period": """SELECT person_id, min(start_date) AS entire_start, max(last_intake) AS entire_end,
        CAST(max(last_intake) + 365 AS DATE) AS cohort_out_date FROM near_eras GROUP BY person_id""",
    "period_labs": """SELECT labs.* FROM labs JOIN period USING (person_id)
        WHERE measurement_date BETWEEN entire_start AND entire_end""",
    "tests": f"""SELECT CASE WHEN measurement_concept_id IN {ids(k.T3_CODES)} THEN 'T3'
             WHEN measurement_concept_id IN {ids(k.T4_CODES)} THEN 'T4'
             WHEN measurement_concept_id IN {ids(k.FREE_T4_CODES)} THEN 'freeT4' END AS hormone,
        m.person_id, measurement_id, measurement_date, {STRIPPED} AS value,
        value_source_value AS text, index_date, last_start
        FROM measurement m JOIN (SELECT person_id, index_date, max(start_date) AS last_start FROM near_eras
                                 GROUP BY person_id, index_date) e ON e.person_id = m.person_id""",
    "before_tests": """SELECT hormone, 1 AS part, CASE WHEN count(*) = count(value) THEN min(value) END AS value FROM (
            SELECT *, min(measurement_date) OVER (PARTITION BY hormone, person_id) AS earliest FROM tests
            WHERE hormone IS NOT NULL AND measurement_date < last_start)
        WHERE measurement_date = earliest GROUP BY hormone, person_id""",
    "text_tests": f"""SELECT hormone, 1 AS part, CASE WHEN count(*) = count(text) THEN {number("min(text)")} END AS value FROM (
            SELECT *, min(measurement_date) OVER (PARTITION BY hormone, person_id) AS earliest FROM tests
            WHERE hormone IS NOT NULL AND measurement_date < last_start)
        WHERE measurement_date = earliest GROUP BY hormone, person_id""",
    "after_tests": """SELECT hormone, 2 AS part, value FROM (
            SELECT *, row_number() OVER (PARTITION BY hormone, person_id
                                         ORDER BY measurement_date DESC, measurement_id) AS rn
            FROM tests WHERE hormone IS NOT NULL AND measurement_date >= index_date) WHERE rn = 1""",
    "classified": """SELECT person_id, condition_concept_id, condition_start_date, index_date,
        CASE WHEN condition_start_date < index_date THEN 'before' WHEN condition_start_date > index_date THEN 'after'
             WHEN condition_start_date = index_date THEN 'same' END AS condition
        FROM condition_occurrence JOIN (SELECT DISTINCT person_id, index_date FROM near_eras) USING (person_id)""",
    "fresh_pairs": """SELECT person_id, condition_concept_id FROM classified WHERE condition = 'after'
        EXCEPT SELECT person_id, condition_concept_id FROM classified WHERE condition = 'before'""",
    "new_codes": """SELECT ICD, n, concept_name FROM (SELECT substr(code, 1, 3) AS ICD, count(*) AS n FROM (
            SELECT f.person_id, f.condition_concept_id, min(c.concept_code) AS code FROM fresh_pairs f
            JOIN concept_relationship r ON r.concept_id_1 = f.condition_concept_id
            JOIN concept c ON c.concept_id = r.concept_id_2
            WHERE c.vocabulary_id = 'ICD10CM' AND r.relationship_id = 'Mapped from'
            GROUP BY f.person_id, f.condition_concept_id) GROUP BY 1)
        LEFT JOIN (SELECT concept_code, concept_name FROM concept WHERE vocabulary_id = 'ICD10CM'
                   AND length(concept_code) = 3) ON ICD = concept_code""",
    "coded": """SELECT concept_code, count(*) AS n FROM condition_occurrence
        JOIN concept_relationship ON concept_id_1 = condition_concept_id AND relationship_id = 'Mapped from'
        JOIN concept ON concept_id = concept_id_2 AND vocabulary_id = 'ICD10CM' GROUP BY concept_code""",
    "blocks": "SELECT substr(concept_code, 1, 3) AS ICD, CAST(sum(n) AS BIGINT) AS n FROM coded GROUP BY 1",
}

RECURSIVE = {"picks", "newton", "pooled_newton", "joint"}


@cache
def needs(text: str) -> tuple[str, ...]:
    """Steps a text names, each after the steps it needs itself."""
    ordered: list[str] = []
    for word in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)):
        if word in STEPS and STEPS[word] != text:
            for step in (*needs(STEPS[word]), word):
                if step not in ordered:
                    ordered.append(step)
    return tuple(ordered)


def sql(text: str) -> str:
    steps = needs(text)
    if not steps:
        return text
    recursive = "RECURSIVE " if RECURSIVE & set(steps) else ""
    parts = [f"{s} AS {'' if s in RECURSIVE else 'MATERIALIZED '}({STEPS[s]})" for s in steps]
    return f"WITH {recursive}" + ",\n".join(parts) + "\n" + text


def rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def without(stage: str, events: str, date: str, condition: str) -> str:
    return (f"SELECT person_id FROM {stage} a WHERE NOT EXISTS (SELECT 1 FROM {events} e "
            f"WHERE e.person_id = a.person_id AND e.{date} <= a.enroll_date + 364 AND ({condition}))")


def drug_free(window: str) -> str:
    return f"""SELECT person_id FROM adult a WHERE NOT EXISTS (SELECT 1 FROM drug_exposure e
        WHERE e.person_id = a.person_id AND e.drug_concept_id IN (SELECT concept_id FROM excl_drug_codes)
        AND ({window}))"""


def chapter_join(rows: str, rule: str) -> str:
    return f"""SELECT Chapter, CAST(n AS BIGINT) AS n, Block, Title, K_title FROM (
        SELECT r.Chapter, sum(b.n) AS n FROM {rows} b LEFT JOIN {rule} GROUP BY r.Chapter)
        LEFT JOIN titles USING (Chapter)"""


def before_after(before: str) -> str:
    return f"""SELECT concat(h.hormone, '_', CAST(h.part AS STRING)) AS name,
        round(CASE WHEN count(t.hormone) = count(t.value) THEN avg(t.value) END, 6) AS value, count(t.hormone) AS n
        FROM (SELECT * FROM (VALUES ('T3', 1), ('T3', 2), ('T4', 1), ('T4', 2), ('freeT4', 1), ('freeT4', 2))
              v(hormone, part)) h
        LEFT JOIN (SELECT * FROM {before} UNION ALL SELECT * FROM after_tests) t
        ON t.hormone = h.hormone AND t.part = h.part GROUP BY h.hormone, h.part"""


# The files that a study writes, and the steps that hold their rows.
RESULT_FILES = {"TABLE1": "freq", "TABLE2": "model_variables", "TABLE3": "model_variables", "diagram": "range(10)",
                "TSH_table": "range(4)", "t_series": "range(6)", "newdisease_topN": "new_codes",
                "newdisease_ICDchapter": "(SELECT DISTINCT r.Chapter FROM new_codes b LEFT JOIN " + """letters r
                    ON r.letter = b.ICD[1] AND TRY_CAST(substr(b.ICD, 2, 2) AS INT) BETWEEN r.low AND r.high)"""}
BY_LETTER = "letters r ON r.letter = b.ICD[1] AND TRY_CAST(substr(b.ICD, 2, 2) AS INT) BETWEEN r.low AND r.high"
ATTRITION = ("(SELECT count(DISTINCT person_id) FROM person)", "(SELECT count(*) FROM entry)",
             "(SELECT count(*) FROM adult)", *[f"(SELECT count(*) FROM stage{i})" for i in range(4, 9)],
             "(SELECT count(*) FROM cases)", "(SELECT count(*) FROM matches)")
CASE_CONTROL = "SELECT person_id, enroll_date, age, gender_concept_id, value, TSH, case_number, indexdt2 FROM case_control"



def cells(name: str, item: str, rows: str, texts: dict[str, str], numbers: dict[str, str]) -> str:
    """Cells of a result file as (name, item, field, text, value) rows."""
    return " UNION ALL ".join(
        [f"SELECT '{name}' AS name, {item} AS item, '{field}' AS field, CASE WHEN TRY_CAST({text} AS DOUBLE) IS NULL THEN {text} END AS text, "
         f"round(TRY_CAST({text} AS DOUBLE), 6) AS value FROM {rows}" for field, text in texts.items()]
        + [f"SELECT '{name}', {item}, '{field}', NULL, round(CAST({number} AS DOUBLE), 6) FROM {rows}" for field, number in numbers.items()])


RESULT_CELLS = " UNION ALL ".join([
    *[f"SELECT 'diagram' AS name, '{i}|{label}' AS item, 'number' AS field, NULL AS text, CAST({count} AS DOUBLE) AS value"
      for i, (label, count) in enumerate(zip(k.ATTRITION_LABELS, ATTRITION), start=1)],
    cells("TABLE2", "variable", "crude", {"level": "level", "converged": "CAST(converged AS VARCHAR)"},
          {"OR": "OR_", **{c: c for c in ("lower_ci", "upper_ci", "estimate", "std_error", "statistic", "p_value")}}),
    cells("TABLE1", "variable || '|' || value", "freq", {}, {c: c for c in ("total", "control", "control_ratio", "patient", "patient_ratio")}),
    cells("newdisease_topN", "ICD", "new_codes", {"concept_name": "concept_name"}, {"n": "n"}),
    *[f"SELECT '{name}', '', 'rows', NULL, CAST((SELECT count(*) FROM {rows}) AS DOUBLE)" for name, rows in RESULT_FILES.items()]])

TEXTS: dict[str, str] = {
    "scan_person": """SELECT person_id, year_of_birth, month_of_birth, day_of_birth, gender_concept_id FROM person""",
    "scan_code_list": """SELECT measurement_id, person_id, measurement_concept_id, measurement_date FROM measurement
        WHERE measurement_concept_id IN (SELECT concept_id FROM tsh_codes)""",
    "scan_person_subset": """SELECT person_id, gender_concept_id FROM person
        WHERE person_id IN (SELECT person_id FROM labs)""",
    "scan_dynamic_column": f"""SELECT measurement_id, person_id, measurement_date FROM measurement
        WHERE measurement_concept_id IN {ids(k.T3_CODES)}""",
    "scan_like_any": f"""SELECT person_id, procedure_date, procedure_source_value FROM procedure_occurrence
        WHERE {SURGERY}""",
    "scan_vocabulary": "SELECT concept_code, n FROM coded",
    "csv_code_list": "SELECT drug_concept_id, count(*) AS n FROM target_drugs GROUP BY drug_concept_id",
    "icd_chapter_lookup": chapter_join("blocks", "ranges r ON b.ICD BETWEEN r.first_code AND r.last_code"),
    "sink_csv_roundtrip": CASE_CONTROL,
    "sink_parquet_roundtrip": CASE_CONTROL,
    "project_column_range": f"SELECT person_id, case_number, {', '.join(k.COMORBIDITIES)} FROM scored",
    "impute_by_prefix": f"SELECT person_id, case_number, {', '.join(k.COMORBIDITIES)} FROM analysis",
    "rename_columns": "SELECT person_id AS subject_id, enroll_date AS first_test_date FROM entry",
    "clean_numeric_regex": f"SELECT measurement_id, {STRIPPED} AS value FROM measurement",
    "birth_dates": "SELECT person_id, birth FROM births",
    "age_duration": """SELECT person_id, round((enroll_date - birth) / 365.25, 6) AS age,
        CAST(floor((enroll_date - birth) / 365.25) AS INT) AS full_years FROM entry JOIN births USING (person_id)""",
    "age_anniversary": f"""SELECT measurement_id, {birthdays("birth", "measurement_date")} AS age
        FROM labs JOIN births USING (person_id)""",
    "exposure_end": f"""SELECT drug_concept_id, min({DRUG_DAYS}) AS first_end, max({DRUG_DAYS}) AS last_end
        FROM drug_exposure GROUP BY drug_concept_id""",
    "enroll_year": "SELECT person_id, CAST(year(enroll_date) AS INT) AS enrollyear FROM entry",
    "recode_gender": "SELECT person_id, CASE WHEN gender_concept_id = 8507 THEN 1 WHEN gender_concept_id <> 8507 THEN 0 END AS gender FROM person",
    "odds_ratio_ci": f"""SELECT variable, level, round(OR_, 6) AS "OR", {rounded("lower_ci", "upper_ci")} FROM crude""",
    "icd_chapter": f"SELECT b.ICD, b.n, r.Chapter FROM blocks b LEFT JOIN {BY_LETTER}",
    "icd_three_char": """SELECT ICD, concept_name, n FROM blocks JOIN concept ON concept_code = ICD
        WHERE vocabulary_id = 'ICD10CM' AND length(concept_code) = 3""",
    "filter_numeric_lab": "SELECT person_id, measurement_id, measurement_concept_id, measurement_date, value FROM labs",
    "filter_out_of_range": "SELECT measurement_id, person_id, value FROM labs WHERE value > 4.5 OR value < 0.5",
    "lookback_endpoint": """SELECT person_id, case_number, drug_concept_id, drug_exposure_start_date, drug_end_date
        FROM taken_rows""",
    "lookback_overlap": """SELECT person_id, case_number, drug_concept_id, drug_exposure_start_date, drug_end_date
        FROM (SELECT c.person_id, case_number, indexdt2, drug_concept_id, drug_exposure_start_date,
                     CAST(drug_exposure_start_date + days_supply - 1 AS DATE) AS drug_end_date
              FROM case_control c JOIN target_drugs USING (person_id))
        WHERE drug_exposure_start_date < indexdt2 AND coalesce(drug_end_date, drug_exposure_start_date) >= indexdt2 - 180""",
    "template_events": f"""SELECT measurement_id, person_id, measurement_date FROM measurement
        WHERE measurement_concept_id IN {ids((*k.T3_CODES, *k.FREE_T4_CODES))}
        AND measurement_date BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'""",
    "lookback_point": """SELECT person_id, case_number, condition_concept_id, condition_start_date
        FROM recent_conditions""",
    "events_in_period": "SELECT measurement_id, person_id, measurement_date FROM period_labs",
    "semi_filter": "SELECT measurement_id, person_id FROM labs WHERE person_id IN (SELECT person_id FROM exposed)",
    "anti_filter": "SELECT person_id FROM person p WHERE NOT EXISTS (SELECT 1 FROM labs l WHERE l.person_id = p.person_id)",
    "join_left": "SELECT p.person_id, enroll_date FROM person p LEFT JOIN entry e ON e.person_id = p.person_id",
    "join_left_renamed": """SELECT condition_concept_id, n, CCI1, CCI2, CCI17 FROM (
        SELECT condition_concept_id, count(*) AS n FROM condition_occurrence GROUP BY 1)
        LEFT JOIN cci_codes ON concept_id = condition_concept_id""",
    "join_inner": """SELECT s.person_id, enroll_date, measurement_id, value
        FROM stage8 s JOIN labs l ON l.person_id = s.person_id""",
    "new_pairs": "SELECT person_id, condition_concept_id FROM fresh_pairs",
    "group_extreme_ties": """SELECT person_id, measurement_id, value FROM (
        SELECT *, rank() OVER (PARTITION BY person_id ORDER BY value DESC) AS place FROM labs) WHERE place = 1""",
    "count_distinct_bitmaps": "SELECT count(DISTINCT person_id) AS persons FROM measurement",
    "scan_listed_events": """SELECT measurement_id, person_id, measurement_concept_id, measurement_date FROM measurement
        WHERE measurement_concept_id IN (SELECT concept_id FROM tsh_codes)""",
    "count_distinct_person": "SELECT count(DISTINCT person_id) AS persons FROM measurement",
    "agg_min_max": f"""SELECT person_id, min(measurement_date) AS first_date, max(measurement_date) AS last_date,
        CASE WHEN count(*) = count(v) THEN min(v) END AS lowest, CASE WHEN count(*) = count(v) THEN max(v) END AS highest
        FROM (SELECT *, {STRIPPED} AS v FROM measurement) GROUP BY person_id""",
    "agg_count": "SELECT measurement_concept_id, count(*) AS n FROM measurement GROUP BY measurement_concept_id",
    "count_of_counts": """SELECT controls, count(*) AS n FROM (
        SELECT count(*) AS controls FROM matches GROUP BY case_number) GROUP BY controls""",
    "mean_and_n": "SELECT round(avg(value), 6) AS value, count(*) AS n FROM labs",
    "pivot_flags": "SELECT person_id, " + ", ".join(
        f"max(CASE WHEN drname = '{c}' THEN 1 ELSE 0 END) AS {c}" for c in k.DRUG_CLASSES)
        + " FROM drug_exposure JOIN cov_drug_codes ON concept_id = drug_concept_id GROUP BY person_id",
    "distinct_rows": "SELECT DISTINCT person_id, drug_concept_id FROM drug_exposure",
    "first_per_group": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY person_id
        ORDER BY measurement_date, measurement_id) AS rn FROM labs) WHERE rn = 1""",
    "last_per_group": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY person_id
        ORDER BY measurement_date DESC, measurement_id) AS rn FROM labs) WHERE rn = 1""",
    "lag_gap": "SELECT person_id, case_number, drug_exposure_start_date2, drug_end_date2, cwc FROM gaps",
    "case_numbering": "SELECT person_id, enroll_date, row_number() OVER (ORDER BY person_id) AS number FROM entry",
    "sorted_output": "SELECT case_number, TSH, person_id FROM case_control ORDER BY case_number, TSH, person_id",
    "sample_k_per_group": """SELECT person_id, measurement_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id
        ORDER BY md5(concat('42|', CAST(person_id AS STRING), '|', CAST(measurement_id AS STRING))), measurement_id) AS rn
        FROM measurement) WHERE rn <= 4""",
    "cohort_entry": "SELECT person_id, enroll_date FROM entry",
    "adult_cohort": "SELECT person_id, enroll_date, birth, round(age, 6) AS age, gender_concept_id FROM adult",
    "exclude_abnormal_first_year": "SELECT person_id FROM stage4",
    "exclude_prior_condition": without("adult", "condition_occurrence", "condition_start_date",
                                       "e.condition_concept_id IN (SELECT concept_id FROM excl_condition_codes)"),
    "exclude_prior_procedure": without("adult", "procedure_occurrence", "procedure_date", SURGERY),
    "exclude_procedure_code": without("adult", "procedure_occurrence", "procedure_date",
                                      f"e.procedure_concept_id IN {ids(k.RADIOIODINE_CODES)}"),
    "exclude_drug_in_window": drug_free(
        "e.drug_exposure_start_date BETWEEN a.enroll_date AND a.enroll_date + 364 "
        "OR e.drug_exposure_end_date BETWEEN a.enroll_date AND a.enroll_date + 364"),
    "exclude_drug_overlap": drug_free(
        "e.drug_exposure_start_date <= a.enroll_date + 364 AND coalesce(e.drug_exposure_end_date, e.drug_exposure_start_date) >= a.enroll_date"),
    "screened_cohort": "SELECT person_id, enroll_date, gender_concept_id, round(age, 6) AS age FROM stage8",
    "attrition": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS no, '{name}' AS name, CAST({count} AS BIGINT) AS number"
        for i, (name, count) in enumerate(zip(k.ATTRITION_LABELS, ATTRITION), start=1)) + ")",
    "attrition_merged": "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {i} AS no, '{name}' AS name, CAST({count} AS BIGINT) AS number"
        for i, (name, count) in enumerate(zip(k.ATTRITION_LABELS, ATTRITION), start=1)) + ")",
    "select_cases": "SELECT case_number, person_id, enroll_date, indexdt, birth, age, value, gender_concept_id FROM cases",
    "candidate_counts": """SELECT case_number, CAST(len(people) AS BIGINT) AS candidates FROM lists""",
    "match_controls": "SELECT case_number, person_id FROM matches",
    "union_case_control": CASE_CONTROL,
    "clip_exposure": "SELECT * FROM exposures",
    "recency_class": "SELECT person_id, case_number, allo, w FROM recency",
    "continuous_use_days": "SELECT person_id, case_number, drugday FROM dose",
    "comorbidity_flags": "SELECT * FROM cci",
    "condition_flag": "SELECT * FROM cdis",
    "drug_class_flags": "SELECT * FROM cdr",
    "assemble_analysis_table": "SELECT * FROM analysis",
    "comorbidity_score": "SELECT person_id, case_number, CCI, CCIGR, gender_concept_id FROM scored",
    "frequency_table": f"""SELECT variable, value, total, control, {rounded("control_ratio")}, patient,
        {rounded("patient_ratio")} FROM freq""",
    "model_variable_list": "SELECT variable FROM model_variables",
    "crude_odds_ratios": f"""SELECT variable, level, round(OR_, 6) AS "OR",
        {rounded("lower_ci", "upper_ci", "estimate", "std_error", "statistic", "p_value")}, converged FROM crude""",
    # Without separated variables, as in the tables that this is compared on.
    "adjusted_odds_ratios": f"""SELECT variable, '1' AS level, round(exp(estimate), 6) AS "OR",
        round(exp(estimate - 1.96 * std_error), 6) AS lower_ci, round(exp(estimate + 1.96 * std_error), 6) AS upper_ci,
        {rounded("estimate", "std_error", "statistic", "p_value")}, true AS converged
        FROM joint_fits JOIN joint_p_values USING (variable)""",
    "frequency_matched_odds": f"""SELECT variable, level, round(OR_, 6) AS "OR",
        {rounded("lower_ci", "upper_ci", "estimate", "std_error", "statistic", "p_value")}, converged FROM pooled_crude""",
    "drug_era_scan": "SELECT person_id, start_date, last_intake, drug_days FROM eras",
    "drug_era_scan_running_max": "SELECT person_id, start_date, last_intake, drug_days FROM eras_max",
    "drug_era": "SELECT person_id, start_date, last_intake, drug_days FROM eras",
    "drug_era_running_max": "SELECT person_id, start_date, last_intake, drug_days FROM eras_max",
    "eras_near_index": "SELECT person_id, start_date, last_intake, drug_days, enroll_date, index_date FROM near_eras",
    "exposure_period": "SELECT person_id, entire_start, entire_end, cohort_out_date FROM period",
    "lab_summary": """SELECT 'TSH_cohortin' AS name, round(avg(value), 6) AS value_mean, count(*) AS n FROM (
            SELECT *, rank() OVER (PARTITION BY person_id ORDER BY measurement_date) AS place
            FROM labs WHERE person_id IN (SELECT person_id FROM exposed)) WHERE place = 1
        UNION ALL SELECT 'TSH_indexdt', round(avg(value), 6), count(*) FROM (
            SELECT *, rank() OVER (PARTITION BY person_id ORDER BY measurement_date) AS place
            FROM period_labs) WHERE place = 1
        UNION ALL SELECT 'TSH_after_indexdt_max', round(avg(value), 6), count(*) FROM (
            SELECT *, rank() OVER (PARTITION BY person_id ORDER BY value DESC) AS place FROM period_labs) WHERE place = 1
        UNION ALL SELECT 'TSH_after_indexdt_mean', round(avg(value), 6), count(*) FROM period_labs""",
    "before_after_text": before_after("text_tests"),
    "sink_result_files": RESULT_CELLS,
    "published_results": RESULT_CELLS,
    "before_after_series": before_after("before_tests"),
    "classify_relative_to_index": """SELECT person_id, condition_concept_id, condition_start_date, index_date, condition
        FROM classified""",
    "top_new_diagnoses": "SELECT ICD, n, concept_name FROM new_codes ORDER BY n DESC, ICD",
    "icd_chapter_rollup": chapter_join("new_codes", BY_LETTER),
}

ORACLES: dict[str, str] = {name: sql(text) for name, text in TEXTS.items()}
