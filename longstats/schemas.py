"""Declared schemas.  Files are always read under one of these, never inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

# Column order of the raw long statistics file (39 columns).
RAW_COLUMNS = [
    "SOURCE_DESC", "SECTOR_DESC", "GROUP_DESC", "COMMODITY_DESC", "CLASS_DESC",
    "PRODN_PRACTICE_DESC", "UTIL_PRACTICE_DESC", "STATISTICCAT_DESC", "UNIT_DESC", "SHORT_DESC",
    "DOMAIN_DESC", "DOMAINCAT_DESC", "AGG_LEVEL_DESC", "STATE_ANSI", "STATE_FIPS_CODE",
    "STATE_ALPHA", "STATE_NAME", "ASD_CODE", "ASD_DESC", "COUNTY_ANSI", "COUNTY_CODE",
    "COUNTY_NAME", "REGION_DESC", "ZIP_5", "WATERSHED_CODE", "WATERSHED_DESC",
    "CONGR_DISTRICT_CODE", "COUNTRY_CODE", "COUNTRY_NAME", "LOCATION_DESC", "YEAR", "FREQ_DESC",
    "BEGIN_CODE", "END_CODE", "REFERENCE_PERIOD_DESC", "WEEK_ENDING", "LOAD_TIME", "VALUE",
    "CV_PERCENT",
]

# Every raw column is text except YEAR (int, required).
RAW_SCHEMA = StructType([
    StructField(name.lower(), IntegerType() if name == "YEAR" else StringType(), name != "YEAR")
    for name in RAW_COLUMNS
])

# Column order of the county classification dimension (45 columns);
# the first three are text, the rest 64-bit floats.
DIMENSION_COLUMNS = [
    "FIPSTXT", "STATE", "COUNTY", "RURALURBANCONTINUUMCODE2013", "URBANINFLUENCECODE2013",
    "RURALURBANCONTINUUMCODE2003", "URBANINFLUENCECODE2003", "METRO2013", "NONMETRO2013",
    "MICROPOLITAN2013", "TYPE_2015_UPDATE", "TYPE_2015_FARMING_NO", "TYPE_2015_MANUFACTURING_NO",
    "TYPE_2015_MINING_NO", "TYPE_2015_GOVERNMENT_NO", "TYPE_2015_RECREATION_NO",
    "LOW_EDUCATION_2015_UPDATE", "LOW_EMPLOYMENT_2015_UPDATE", "POPULATION_LOSS_2015_UPDATE",
    "RETIREMENT_DESTINATION_2015_UPDATE", "PERPOV_1980_0711", "PERSISTENTCHILDPOVERTY_1980_2011",
    "HIPOV", "HIAMENITY", "HICREATIVECLASS2000", "GAS_CHANGE", "OIL_CHANGE", "OIL_GAS_CHANGE",
    "METRO2003", "NONMETRONOTADJ2003", "NONMETROADJ2003", "NONCORE2003", "ECONOMICDEPENDENCE2000",
    "NONMETRO2003", "MICROPOLITAN2003", "FARMDEPENDENT2003", "MANUFACTURINGDEPENDENT2000",
    "LOWEDUCATION2000", "RETIREMENTDESTINATION2000", "PERSISTENTPOVERTY2000", "NONCORE2013",
    "TYPE_2015_NONSPECIALIZED_NO", "METRO_ADJACENT2013", "PERSISTENTCHILDPOVERTY2004",
    "RECREATIONDEPENDENT2000",
]

DIMENSION_SCHEMA = StructType([
    StructField(name.lower(), StringType() if i < 3 else DoubleType(), True)
    for i, name in enumerate(DIMENSION_COLUMNS)
])

# The 19 raw columns the cleaning jobs read (the derived fixture has exactly these).
LONG_COLUMNS = [
    "source_desc", "commodity_desc", "class_desc", "prodn_practice_desc", "util_practice_desc",
    "statisticcat_desc", "unit_desc", "short_desc", "domain_desc", "agg_level_desc",
    "state_fips_code", "state_alpha", "state_name", "county_code", "county_name", "year",
    "freq_desc", "reference_period_desc", "value",
]

LONG_SCHEMA = StructType([
    StructField(name, IntegerType() if name == "year" else StringType(), name != "year")
    for name in LONG_COLUMNS
])

# Output columns of the tidy county table, in order.
TIDY_COLUMNS = [
    "year", "calendar_date", "fips_county_code", "state_alpha", "state_name", "county_name",
    "commodity_name", "commodity_class_variety", "production_unit", "production_unit_conversion",
    "production_unit_multiplier", "yield_unit", "production_to_yield_multiplier", "area_planted",
    "area_harvested", "crop_production", "crop_yield",
]

MEASURES = ["area_planted", "area_harvested", "crop_production", "crop_yield"]

_TIDY_TYPES = {
    "year": IntegerType(), "calendar_date": DateType(), "production_unit_multiplier": DecimalType(5, 3),
    "production_to_yield_multiplier": DoubleType(), **{m: DecimalType(38, 3) for m in MEASURES},
}

TIDY_SCHEMA = StructType([StructField(c, _TIDY_TYPES.get(c, StringType()), True) for c in TIDY_COLUMNS])
