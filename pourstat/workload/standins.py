"""Stand-in source tables, derived by SQL from the supplied benchmark tables.

The same text runs on Spark and, inlined as common table expressions, in the SQL
checks. Missing values, not-applicable flags, spelling variants and duplicates are
injected by arithmetic on keys, so the stand-ins grow with the supplied tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def _measurement(prefix: str, start: float, step: int, span: int, low: float, high: float, n: int) -> str:
    """Eight raw columns of one measurement; ``n`` shifts the injected gaps."""
    k = "o.o_orderkey"
    value = f"CAST({start} AS DOUBLE) + CAST(({k} * {step}) % {span} AS DOUBLE) / 10"
    after = f"CAST({start} AS DOUBLE) + CAST(({k} * {step + 2}) % {span} AS DOUBLE) / 10"
    return f"""
      CASE WHEN {k} % {n + 9} <> 1 THEN {value} END AS {prefix}_actual,
      CASE WHEN {k} % {n + 5} = 0 THEN 1 WHEN {k} % {n + 7} = 0 THEN NULL ELSE 0 END AS {prefix}_actualNA,
      CASE WHEN {k} % {n + 4} = 0 THEN {after} END AS {prefix}_afterSP,
      CASE WHEN {k} % {n + 8} = 0 THEN 1 WHEN {k} % {n + 3} = 0 THEN NULL ELSE 0 END AS {prefix}_afterSPNA,
      CASE WHEN {k} % {n + 6} <> 0 THEN CAST({low} AS DOUBLE) END AS {prefix}_specMin,
      CASE WHEN {k} % {n + 11} = 0 THEN 1 WHEN {k} % 3 = 0 THEN NULL ELSE 0 END AS {prefix}_specMinNA,
      CASE WHEN {k} % {n + 9} <> 0 THEN CAST({high} AS DOUBLE) END AS {prefix}_specMax,
      CASE WHEN {k} % {n + 13} = 0 THEN 1 WHEN {k} % 4 = 0 THEN NULL ELSE 0 END AS {prefix}_specMaxNA"""


_MEASUREMENTS = ",".join(
    [
        _measurement("uwSlump", 0.0, 1, 120, 3, 8, 0),
        _measurement("uwSpread", 18.0, 7, 150, 20, 30, 1),
        _measurement("uwAir", 1.0, 3, 110, 4, 8, 2),
        _measurement("uwWeight", 128.0, 5, 300, 135, 152, 3),
        _measurement("uwConcreteTemp", 40.0, 11, 600, 50, 90, 4),
    ]
)

VIEWS: dict[str, str] = {
    "offices": "SELECT n_nationkey AS officeId, n_name AS name FROM {nation}",
    "projects": """
SELECT c_custkey AS projectId, concat('P-', CAST(c_custkey AS STRING)) AS projectNo,
       c_nationkey AS officeId FROM {customer}""",
    "samples": """
SELECT o_orderkey AS id, concat('L', CAST(o_orderkey AS STRING)) AS labNo,
       o_custkey AS projectId FROM {orders}""",
    "tests": "SELECT o_orderkey AS testId, o_orderkey AS sampleId FROM {orders}",
    "suppliers": "SELECT s_suppkey AS id, s_name AS name FROM {supplier}",
    "lookup": """
SELECT r_regionkey AS resourceId, 0 AS localeId, r_name AS value FROM {region}
UNION ALL SELECT r_regionkey, 1, lower(r_name) FROM {region}""",
    "concrete_tests": f"""
SELECT o.o_orderkey * 2 + 1 AS id, o.o_orderkey AS testbaseId,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE o.o_custkey % 97 END AS supplierId,
       CASE WHEN o.o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS unitSystem,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 30050 ELSE 30051 END AS testSubTypeId,
       CASE WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS castDate,
       CASE WHEN o.o_orderkey % 19 <> 0 THEN o.o_orderdate + (o.o_orderkey % 1430) * INTERVAL '1' MINUTE END AS batchTime,
       CASE WHEN o.o_orderkey % 23 <> 0 THEN o.o_orderdate + ((o.o_orderkey * 7) % 1439) * INTERVAL '1' MINUTE
            + (o.o_orderkey % 60) * INTERVAL '1' SECOND END AS sampleTime,
       CASE WHEN o.o_orderkey % 29 <> 0 THEN o.o_orderdate + ((o.o_orderkey * 11) % 1439) * INTERVAL '1' MINUTE END AS finishTime,
       o.o_orderpriority AS placementType,
       concat('00', CAST(o.o_custkey % 3 AS STRING)) AS plantNumber,
       concat(o.o_orderstatus, '-', CAST(o.o_orderkey % 2 AS STRING)) AS mixNumber,
       CAST(o.o_orderkey % 12 AS DOUBLE) AS batchSize,
       CASE WHEN o.o_orderkey % 31 = 0 THEN 1 WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE 0 END AS LoadBatchVolumneNA,
       CASE WHEN o.o_orderkey % 15 <> 0 THEN CAST(o.o_orderkey % 25 AS DOUBLE) / 2 END AS waterAdded,
       CASE WHEN o.o_orderkey % 17 = 0 THEN 1 WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE 0 END AS waterAddedNA,
       CAST(o.o_orderkey % 110 AS DOUBLE) - 5 AS ambientTemp,
       CASE WHEN o.o_orderkey % 14 = 0 THEN 1 WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE 0 END AS ambientTempNA,
       CASE WHEN o.o_orderkey % 4 = 0 THEN '  ' WHEN o.o_orderkey % 4 = 1 THEN NULL
            WHEN o.o_orderkey % 4 = 2 THEN concat(' Cure  Box #', CAST(o.o_orderkey % 7 AS STRING), ' ')
            ELSE concat('60F-', o.o_orderpriority) END AS initialCuringCondition,
       CAST(o.o_orderkey % 7 AS INT) AS resWaterUnits, CAST(o.o_orderkey % 5 AS INT) AS resCloudType,
       CAST(o.o_orderkey % 6 AS INT) AS resPrecipitationType, CAST(o.o_orderkey % 3 AS INT) AS resWindType,
       CASE WHEN o.o_orderkey % 2 = 0 THEN CAST(o.o_orderkey % 4 AS INT) END AS resFinalCure,
       CASE WHEN o.o_orderkey % 21 <> 0 THEN CAST(3000 + o.o_orderkey % 2500 AS DOUBLE) END AS cementQuantity,
       CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(o.o_orderkey % 900 AS DOUBLE) END AS flyAshQuantity,
       CAST(1500 + o.o_orderkey % 700 AS DOUBLE) AS waterQuantity,
       CAST(o.o_orderkey % 11 AS DOUBLE) AS calcYield,
       CASE WHEN o.o_orderkey % 27 <> 0 THEN CAST(o.o_orderkey % 80 AS DOUBLE) / 100 + CAST(o.o_custkey % 10 AS DOUBLE) / 40 END AS calcWCRatio,
       CASE WHEN o.o_orderkey % 33 <> 0 THEN CAST(350 + o.o_orderkey % 500 AS DOUBLE) END AS calcCementContent,
       {_MEASUREMENTS}
FROM {{orders}} o""",
    "batch_rows": """
SELECT l_orderkey * 2 + 1 AS concreteTestId,
       CASE l_linenumber WHEN 1 THEN 'Misc Sand 1' WHEN 2 THEN ' MISC SAND 2 ' WHEN 3 THEN 'MISC AGGREGATE 1'
            WHEN 4 THEN 'misc aggregate 2' WHEN 5 THEN 'MISC AGGREGATE 3' ELSE 'ADMIX' END AS name,
       CASE WHEN l_quantity > 2 THEN l_quantity * 20 ELSE CAST(0 AS DOUBLE) END AS weight,
       CASE WHEN l_tax = 0.0 THEN NULL WHEN l_partkey % 401 = 0 THEN CAST(-100 AS DOUBLE) ELSE l_tax * 100 END AS moisture
FROM {lineitem}""",
    "strength_rows": """
SELECT o_orderkey * 2 + 1 AS concreteTestId, 28 AS days, 30010 AS strengthType,
       CAST(3000 + 500 * (o_custkey % 5) AS DOUBLE) AS strength FROM {orders} WHERE o_orderkey % 7 <> 0
UNION ALL
SELECT o_orderkey * 2 + 1, CASE WHEN o_orderkey % 2 = 0 THEN 28 ELSE 7 END, 30011,
       CAST(2500 + 500 * (o_custkey % 5) AS DOUBLE) FROM {orders} WHERE o_orderkey % 3 = 0
UNION ALL
SELECT o_orderkey * 2 + 1, 28, CASE WHEN o_orderkey % 2 = 0 THEN 30010 ELSE 30099 END,
       CASE WHEN o_orderkey % 10 <> 0 THEN CAST(3200 AS DOUBLE) END FROM {orders} WHERE o_orderkey % 5 = 0""",
    "specimen_rows": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
              CAST(l_linenumber AS STRING)) AS id,
       l_orderkey * 2 + 1 AS concreteTestId,
       CASE WHEN l_linenumber <= 2 THEN 7 WHEN l_linenumber <= 6 THEN 28 ELSE 56 END AS daysToAge,
       CASE WHEN l_partkey % 53 = 0 THEN NULL WHEN l_partkey % 59 = 0 THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS wasFieldCured,
       CASE WHEN l_discount > 0.0 THEN floor(l_extendedprice) / 10 END AS calcCompressiveStrength,
       CASE WHEN l_discount > 0.05 THEN l_extendedprice / 10 END AS calcCompressiveStrengthUnrounded,
       CASE WHEN l_partkey % 37 <> 0 THEN CAST(l_shipdate AS DATE) END AS testedOnDate
FROM {lineitem}""",
    # Specimen grain with the requirement attached and a mostly regular break date.
    "specimens": """
SELECT l.l_orderkey AS testId,
       concat(CAST(l_orderkey AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-',
              CAST(l_linenumber AS STRING)) AS SpecimenRowId,
       CASE WHEN l_linenumber <= 2 THEN 7 WHEN l_linenumber <= 6 THEN 28 ELSE 56 END AS daysToAge,
       CASE WHEN l_partkey % 53 = 0 THEN NULL WHEN l_partkey % 59 = 0 THEN 2 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS wasFieldCured,
       CASE WHEN l_orderkey % 43 <> 0 THEN CAST(o.o_orderdate AS DATE) END AS castDate,
       CASE WHEN l_partkey % 37 <> 0 THEN CAST(o.o_orderdate + (28 + l_partkey % 4 - 1) * INTERVAL '1' DAY AS DATE) END AS testedOnDate,
       CASE WHEN l_orderkey % 7 <> 0 THEN CASE WHEN l_suppkey % 9 = 0 THEN 56 ELSE 28 END END AS SpecifiedBreakAge,
       CASE WHEN l_orderkey % 7 <> 0 AND l_linenumber % 2 = 0 THEN CAST(3000 + 500 * (o.o_custkey % 5) AS DOUBLE) END AS RequiredStrength,
       CASE WHEN l_orderkey % 3 = 0 THEN CAST(2500 + 500 * (o.o_custkey % 5) AS DOUBLE) END AS DesignStrength,
       CASE WHEN l_orderkey % 7 <> 0 THEN CAST(1 + l_linenumber % 2 AS INT) END AS RequiredStrengthRowCount,
       CASE WHEN l_orderkey % 3 = 0 THEN CAST(1 AS INT) END AS DesignStrengthRowCount,
       CASE WHEN l_discount > 0.0 THEN floor(l_extendedprice) / 10 - 100 END AS calcCompressiveStrength,
       concat('00', CAST(o.o_custkey % 3 AS STRING)) AS plantNumber,
       concat('0', CAST(o.o_orderkey % 10 AS STRING), ':', CAST(10 + o.o_orderkey % 50 AS STRING), ':00') AS batchTime,
       CASE WHEN o.o_orderkey % 6 <> 0 THEN concat('0', CAST(o.o_custkey % 10 AS STRING), ':', CAST(10 + o.o_orderkey % 49 AS STRING), ':30')
            ELSE 'late' END AS sampleTime
FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey""",
    # One row per test as exported text: dirty numbers, flags, blanks, duplicates.
    "export_rows": """
SELECT CAST(CASE WHEN o_orderkey % 101 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS STRING) AS testId,
       CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE CAST(o_custkey AS STRING) END AS projectId,
       CASE WHEN o_orderkey % 11 = 0 THEN '1' WHEN o_orderkey % 12 = 0 THEN 'NULL' ELSE '0' END AS ConcreteTestUnitSystem,
       CASE WHEN o_orderkey % 41 = 0 THEN '' WHEN o_orderkey % 37 = 0 THEN 'not a date'
            WHEN o_orderkey % 39 = 0 THEN '1899-01-01' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS castDate,
       CASE WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 5 = 0 THEN concat(CAST(o_orderkey % 9 AS STRING), ',', CAST(100 + o_orderkey % 900 AS STRING))
            WHEN o_orderkey % 97 = 0 THEN 'NaN' WHEN o_orderkey % 89 = 0 THEN '25000' ELSE CAST(o_orderkey % 9000 AS STRING) END AS AverageActualStrength28_psi,
       CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 51 = 0 THEN '-5' WHEN o_orderkey % 53 = 0 THEN '900'
            ELSE CAST(3000 + 500 * (o_custkey % 5) AS STRING) END AS ApplicableSpecifiedStrength28,
       CASE WHEN o_orderkey % 3 = 0 THEN 'abc' WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 35 AS STRING) END AS EffectiveSlump_in,
       CASE WHEN o_orderkey % 6 < 3 THEN '' ELSE CAST(o_orderkey % 25 AS STRING) END AS EffectiveAir_percent,
       CASE WHEN o_orderkey % 8 < 4 THEN ' ' ELSE CAST(30 + o_orderkey % 200 AS STRING) END AS EffectiveUnitWeight_lb_ft3,
       CASE WHEN o_orderkey % 12 < 6 THEN 'NULL' ELSE CAST(o_orderkey % 190 - 25 AS STRING) END AS EffectiveConcreteTemp_F,
       CAST(o_orderkey % 300 - 100 AS STRING) AS AmbientTemp_F,
       CASE WHEN o_orderkey % 9 = 0 THEN 'True' WHEN o_orderkey % 9 = 1 THEN ' no ' WHEN o_orderkey % 9 = 2 THEN '2'
            WHEN o_orderkey % 9 = 3 THEN 'Y' WHEN o_orderkey % 9 = 4 THEN '0.0' WHEN o_orderkey % 9 = 5 THEN 'maybe'
            WHEN o_orderkey % 9 = 6 THEN NULL WHEN o_orderkey % 9 = 7 THEN 't' ELSE '1' END AS HasWaterAdded,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat(' supplier  ', CAST(o_custkey % 10 AS STRING))
            ELSE concat('Supplier ', CAST(o_custkey % 10 AS STRING)) END AS SupplierName,
       concat('00', CAST(o_custkey % 3 AS STRING)) AS plantNumber,
       CASE WHEN o_orderkey % 19 = 0 THEN 'none' ELSE concat(o_orderstatus, ' ', CAST(o_orderkey % 2 AS STRING)) END AS mixNumber
FROM {orders}""",
    # One row per test with typed columns: the shape of the extract, kept narrow.
    "facts": """
SELECT o.o_orderkey AS testId,
       CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_custkey % 250 END AS projectId,
       c.c_nationkey AS officeId,
       CASE WHEN o.o_orderkey % 41 = 0 THEN NULL ELSE CAST(o.o_orderdate AS DATE) END AS castDate,
       CASE WHEN o.o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS ConcreteTestUnitSystem,
       CASE WHEN o.o_orderkey % 41 = 0 THEN 0 ELSE 1 END AS IsValidCastDate,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 30050 WHEN o.o_orderkey % 3 = 1 THEN 30051 END AS testSubTypeId,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL WHEN o.o_orderkey % 3 = 0 THEN concat(' supplier  ', CAST(o.o_custkey % 10 AS STRING))
            ELSE concat('Supplier ', CAST(o.o_custkey % 10 AS STRING)) END AS SupplierName,
       CASE WHEN o.o_orderkey % 29 = 0 THEN NULL ELSE concat('00', CAST(o.o_custkey % 3 AS STRING)) END AS plantNumber,
       concat(o.o_orderstatus, '-', CAST(o.o_orderkey % 2 AS STRING)) AS mixNumber,
       CASE WHEN o.o_orderkey % 23 = 0 THEN NULL ELSE CAST(1000 + (o.o_orderkey * 7919) % 8000 AS DOUBLE) END AS AverageActualStrength28_psi,
       CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(3000 + 500 * (o.o_custkey % 5) AS DOUBLE) END AS ApplicableSpecifiedStrength28,
       CASE WHEN o.o_orderkey % 9 = 0 THEN NULL ELSE CAST(700 + (o.o_orderkey * 7919) % 8000 * 6 / 10 + o.o_orderkey % 400 AS DOUBLE) END AS AverageActualStrength7_psi,
       CASE WHEN o.o_orderkey % 9 = 0 THEN 0 ELSE CAST(1 + o.o_orderkey % 3 AS INT) END AS ActualStrength7SpecimenCount,
       CASE WHEN o.o_orderkey % 23 = 0 THEN 0 ELSE CAST(1 + o.o_orderkey % 4 AS INT) END AS ActualStrength28SpecimenCount,
       CAST(o.o_orderkey % 2 AS INT) AS FieldCuredStrength7SpecimenCount,
       CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE CAST(o.o_orderkey % 5 AS INT) END AS FieldCuredStrength28SpecimenCount,
       CASE WHEN o.o_orderkey % 31 = 0 THEN 1 ELSE CASE WHEN 1000 + (o.o_orderkey * 7919) % 8000 < 3000 + 500 * (o.o_custkey % 5) THEN 1 ELSE 0 END END AS FailureFlag28,
       CASE WHEN o.o_orderkey % 8 <> 0 THEN CAST(o.o_orderkey % 250 AS DOUBLE) / 10 - 1 END AS EffectiveSlump_in,
       CASE WHEN o.o_orderkey % 8 = 0 THEN CAST(150 + o.o_orderkey % 500 AS DOUBLE) / 10 END AS EffectiveSpread_in,
       CASE WHEN o.o_orderkey % 5 <> 0 THEN CAST((o.o_orderkey * 3) % 120 AS DOUBLE) / 10 END AS EffectiveAir_percent,
       CASE WHEN o.o_orderkey % 6 <> 0 THEN CAST(1280 + (o.o_orderkey * 5) % 300 AS DOUBLE) / 10 END AS EffectiveUnitWeight_lb_ft3,
       CASE WHEN o.o_orderkey % 10 <> 0 THEN CAST(40 + (o.o_orderkey * 11) % 100 AS DOUBLE) END AS EffectiveConcreteTemp_F,
       CAST(o.o_orderkey % 110 AS DOUBLE) - 5 AS AmbientTemp_F,
       CASE WHEN o.o_orderkey % 15 <> 0 THEN CAST(o.o_orderkey % 60 AS DOUBLE) / 4 END AS WaterAdded_gal_per_yd3,
       CAST(o.o_orderkey % 1500 AS DOUBLE) AS BatchToSampleMinutes,
       CASE WHEN o.o_orderkey % 14 <> 0 THEN CAST((o.o_orderkey * 3) % 1600 AS DOUBLE) END AS BatchToCastMinutes,
       CASE WHEN o.o_orderkey % 15 = 0 THEN NULL WHEN o.o_orderkey % 60 = 0 THEN 0 ELSE 1 END AS HasWaterAdded,
       CAST(o.o_orderkey % 2 AS INT) AS HasAnyAfterSPMeasurement,
       CASE WHEN o.o_orderkey % 6 <> 0 THEN CAST(3 AS DOUBLE) END AS uwSlump_specMin,
       CASE WHEN o.o_orderkey % 9 <> 0 THEN CAST(8 AS DOUBLE) END AS uwSlump_specMax,
       CASE WHEN o.o_orderkey % 6 = 1 THEN CAST(4 AS DOUBLE) END AS uwAir_specMin,
       CAST(7 AS DOUBLE) AS uwAir_specMax,
       CASE WHEN o.o_orderkey % 8 = 0 THEN NULL WHEN o.o_orderkey % 250 < 40 OR o.o_orderkey % 250 > 90 THEN 1 ELSE 0 END AS SlumpOutOfSpecFlag,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL WHEN (o.o_orderkey * 3) % 120 > 70 THEN 1 ELSE 0 END AS AirOutOfSpecFlag,
       CASE WHEN o.o_orderkey % 4 = 0 THEN CAST(0 AS DOUBLE) WHEN o.o_orderkey % 4 = 1 THEN NULL ELSE CAST(o.o_orderkey % 9 AS DOUBLE) END AS WaterAddedRaw,
       CASE WHEN o.o_orderkey % 3 = 0 THEN NULL WHEN o.o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS waterAddedNA,
       CASE WHEN o.o_orderkey % 6 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o.o_orderkey % 12 AS DOUBLE) END AS LoadBatchVolumeRaw,
       CASE WHEN o.o_orderkey % 5 = 0 THEN NULL WHEN o.o_orderkey % 5 = 1 THEN 1 ELSE 0 END AS LoadBatchVolumeNA,
       CASE WHEN o.o_orderkey % 4 = 0 THEN '  ' WHEN o.o_orderkey % 4 = 1 THEN NULL
            WHEN o.o_orderkey % 4 = 2 THEN concat(' Cure  Box #', CAST(o.o_orderkey % 7 AS STRING), ' ')
            ELSE concat('60F-', CAST(o.o_orderkey % 900 AS STRING)) END AS InitialCuringConditionRaw,
       CASE WHEN o.o_orderkey % 33 <> 0 THEN CAST(50 + o.o_orderkey % 900 AS DOUBLE) END AS CalcCementContent_lbs_yd3,
       CASE WHEN o.o_orderkey % 3 = 0 THEN CAST(o.o_orderkey % 300 AS DOUBLE) END AS FlyAshContent_lbs_yd3,
       CASE WHEN o.o_orderkey % 27 <> 0 THEN CAST(o.o_orderkey % 110 AS DOUBLE) / 100 END AS calcWCRatio,
       CASE WHEN o.o_orderkey % 35 <> 0 THEN CAST((o.o_orderkey * 13) % 4000 AS DOUBLE) END AS SandSSD_lbs_yd3,
       CASE WHEN o.o_orderkey % 36 <> 0 THEN CAST((o.o_orderkey * 17) % 4500 AS DOUBLE) END AS AggregateSSD_lbs_yd3,
       CASE WHEN o.o_orderkey % 38 <> 0 THEN CAST(o.o_orderkey % 45 AS DOUBLE) - 12 END AS SandMoisture_percent,
       CASE WHEN o.o_orderkey % 40 <> 0 THEN CAST(o.o_orderkey % 40 AS DOUBLE) - 12 END AS AggregateMoisture_percent,
       CASE WHEN o.o_orderkey % 20 = 0 THEN NULL ELSE CAST(24 + o.o_orderkey % 14 AS DOUBLE) END AS AverageActualAgeDays,
       CASE WHEN o.o_orderkey % 12 = 0 THEN 56 ELSE 28 END AS SpecifiedBreakAge,
       CASE WHEN o.o_orderkey % 12 = 0 THEN 'False' ELSE 'True' END AS SpecifiedBreakAgeIs28,
       CASE WHEN o.o_orderkey % 7 = 0 THEN 'True' ELSE 'False' END AS SpecifiedStrengthMissing
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    # Out-of-fold predictions of two models and two feature sets.
    "predictions": """
SELECT s.testId, m.Model, f.FeatureSet, s.testId % 5 + 1 AS Fold, s.castYear, s.actual AS ActualStrength28_psi,
       s.required AS RequiredStrength28_psi,
       CASE WHEN s.actual < s.required THEN 1 ELSE 0 END AS ActualFailureFlag,
       CASE WHEN m.Model = 'A' THEN s.actual * 0.5 + 2000 + f.shift ELSE s.actual * 0.25 + CAST((s.testId * 31) % 400 AS DOUBLE) * 10 + f.shift END AS PredictedStrength28_psi,
       CAST((s.testId * 7919 + CASE WHEN m.Model = 'A' THEN 0 ELSE 17 END) % 1000 AS DOUBLE) / 1000 AS FailureProbability
FROM (SELECT l.l_orderkey AS testId, CAST(floor(sum(floor(l.l_extendedprice)) / 10 / count(*)) AS DOUBLE) AS actual, CAST(max(year(o.o_orderdate)) AS INT) AS castYear,
             CAST(max(3000 + 500 * (o.o_custkey % 5)) AS DOUBLE) AS required
      FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_orderkey) s
JOIN (SELECT 'A' AS Model, 1 AS j UNION ALL SELECT 'B', 1) m ON m.j = 1
JOIN (SELECT 'Day0_Context' AS FeatureSet, CAST(0 AS DOUBLE) AS shift, 1 AS j UNION ALL
      SELECT 'Day7_FieldPlusRequired', CAST(40 AS DOUBLE), 1) f ON f.j = 1""",
}

EXTRACT_TABLES = [
    "offices",
    "projects",
    "samples",
    "tests",
    "suppliers",
    "lookup",
    "concrete_tests",
    "batch_rows",
    "strength_rows",
    "specimen_rows",
]


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table as a DataFrame."""
    text = VIEWS[name]
    used = {t: base_table(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def extract_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: view(spark, sf_dir, name) for name in EXTRACT_TABLES}


def cte(*names: str) -> str:
    """The named stand-ins as the head of a SQL check."""
    plain = {t: t for t in BASE_TABLES}
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in names)
