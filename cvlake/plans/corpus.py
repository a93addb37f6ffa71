"""An invented corpus of résumés, derived from the customer table by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORPUS_SQL = """
WITH k AS (
  SELECT CAST(c_custkey AS BIGINT) AS doc_id, CAST(c_custkey AS INT) AS k,
    CASE CAST(c_custkey AS INT) % 8 WHEN 0 THEN 'Maria' WHEN 1 THEN 'Stella' WHEN 2 THEN 'John' WHEN 3 THEN 'AISHA' WHEN 4 THEN 'Piotr' WHEN 5 THEN 'Anne-Marie' WHEN 6 THEN 'Liam' ELSE 'Omar' END AS first_name,
    translate(lpad(CAST(c_custkey AS STRING), 6, '0'), '0123456789', 'abdeiklnor') AS last_name
  FROM customer),
p AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'warehouse' ELSE 'hospitality' END AS sector,
    first_name || ' ' || upper(substr(last_name, 1, 1)) || substr(last_name, 2) AS full_name,
    '07' || lpad(CAST((CAST(k AS BIGINT) * 7919) % 1000 AS STRING), 3, '0') || ' ' || lpad(CAST((CAST(k AS BIGINT) * 104729) % 1000000 AS STRING), 6, '0') AS phone,
    CASE k % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'TW' WHEN 2 THEN 'SW' ELSE 'LS' END || CAST(k % 19 + 1 AS STRING) || CASE k % 2 WHEN 0 THEN ' ' ELSE '' END || CAST(k % 10 AS STRING) || CASE k % 5 WHEN 0 THEN 'NU' WHEN 1 THEN 'ae' ELSE 'XB' END AS postcode
  FROM k)
SELECT doc_id, sector,
  CASE k % 5 WHEN 0 THEN 'CV-' || replace(full_name, ' ', '-') || '.pdf' WHEN 1 THEN 'Resume_' || replace(full_name, ' ', '_') || '.docx' WHEN 2 THEN 'cv ' || replace(full_name, ' ', '') || ' 2024.docx' WHEN 3 THEN 'Resume - ' || full_name || ' (1).pdf' ELSE full_name || ' final CV.pdf' END AS filename,
  CASE k % 6 WHEN 0 THEN 'Name: ' || full_name WHEN 1 THEN 'CURRICULUM VITAE' || chr(10) || full_name ELSE full_name END || chr(10)
  || CASE k % 7 WHEN 0 THEN '' ELSE 'Email: ' || lower(first_name) || '.' || last_name || '@example.org' || chr(10) END
  || CASE k % 4 WHEN 0 THEN 'Mobile: +44 ' || substr(phone, 2) ELSE 'Mobile: ' || phone END || chr(10)
  || CAST(k % 200 + 1 AS STRING) || CASE k % 3 WHEN 0 THEN ' Station Road' WHEN 1 THEN ' The Green' ELSE ' Mill Lane' END || chr(10)
  || CASE k % 9 WHEN 0 THEN 'Leeds' ELSE 'London, ' || postcode END || chr(10) || chr(10)
  || CASE k % 2 WHEN 0 THEN 'PROFILE' ELSE 'Professional Summary:' END || chr(10)
  || 'Reliable ' || sector || ' worker with ' || CAST(k % 12 AS STRING) || ' years of experience in customer service and team work' || chr(10)
  || CASE k % 3 WHEN 0 THEN 'Trained in conflict management, CCTV and health and safety on busy sites' WHEN 1 THEN 'Used to picking and packing with a handheld scanner in a large warehouse' ELSE 'Experienced room attendant with an eye for detail and good communication' END || chr(10) || chr(10)
  || CASE k % 2 WHEN 0 THEN 'KEY SKILLS' ELSE 'Skills:' END || chr(10)
  || CASE k % 3 WHEN 0 THEN '• Door supervisor, CCTV, Access control' || chr(10) || '• Radio communication and patrolling' WHEN 1 THEN 'forklift; RF scanner; stock control / manual handling' || chr(10) || '- Microsoft Excel' ELSE 'Front of house | bar service | food hygiene' || chr(10) || '* HOUSEKEEPING' END || chr(10)
  || CASE k % 5 WHEN 0 THEN 'GDPR' || chr(10) WHEN 1 THEN 'C.C.T.V' || chr(10) WHEN 2 THEN 'D.B.S.' || chr(10) ELSE '' END || chr(10)
  || CASE k % 2 WHEN 0 THEN 'WORK EXPERIENCE' ELSE 'Employment:' END || chr(10)
  || CASE k % 3 WHEN 0 THEN 'Security Officer - Acme Guarding' WHEN 1 THEN 'Warehouse Operative | Big Boxes Ltd' ELSE 'Room Attendant, Grand Hotel' END || chr(10)
  || CASE k % 4 WHEN 0 THEN 'Jan ' WHEN 1 THEN 'September ' WHEN 2 THEN 'Mar ' ELSE '' END || CAST(2012 + k % 6 AS STRING) || CASE k % 2 WHEN 0 THEN ' - ' ELSE ' to ' END || CASE k % 4 WHEN 0 THEN 'Dec ' WHEN 1 THEN 'June ' WHEN 2 THEN 'May ' ELSE '' END || CAST(2018 + k % 4 AS STRING) || chr(10)
  || '• Carried out daily checks of the whole site and wrote reports' || chr(10) || '• Welcomed visitors and helped colleagues' || chr(10) || CASE k % 2 WHEN 0 THEN '- Kept records up to date' || chr(10) ELSE '' END
  || CASE k % 3 WHEN 0 THEN 'Steward - City Events' WHEN 1 THEN 'Packer - Parcel House' ELSE 'Waiter - Corner Cafe' END || chr(10)
  || CAST(2019 + k % 3 AS STRING) || CASE k % 5 WHEN 0 THEN ' - present' WHEN 1 THEN '–2022' ELSE ' - 2023' END || chr(10)
  || '• Looked after guests during long evening shifts' || chr(10) || '• Looked after guests during long evening shifts' || chr(10) || chr(10)
  || CASE k % 4 WHEN 0 THEN 'CERTIFICATIONS' || chr(10) || 'SIA Door Supervisor' || chr(10) || 'First Aid certificate' || chr(10) || 'SIA DOOR SUPERVISOR' WHEN 1 THEN 'Licences & Training' || chr(10) || 'CSCS card' || chr(10) || 'Food hygiene' ELSE 'EDUCATION' || chr(10) || 'GCSE English and Maths' END AS text
FROM p
"""


def cv_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sector, filename, text) of invented résumés, one for each customer."""
    # only keys are dealt out; texts are made where they land, so that one small file doesn't make one task of all parsing
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").repartition(spark.sparkContext.defaultParallelism)
    # a filter on texts would go below the exchange, and with it the making of them, into that task; it can't go below explode()
    keys.select(F.explode(F.array("c_custkey")).alias("c_custkey")).createOrReplaceTempView("customer")
    return spark.sql(CORPUS_SQL)
