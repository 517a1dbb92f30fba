"""Column names, label tables and numeric settings of the declaration data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Columns:
    """Which column plays which role, so the operators run on any table of this kind."""

    id: str = "id"
    entity: str = "disasterNumber"
    date: str = "declarationDate"
    geo: str = "state"
    group: str = "femaRegion"
    category: str = "incidentType"
    type_code: str = "declarationType"
    type_label: str = "declarationTypeLabel"
    area: str = "designatedArea"


# The published file's columns, in file order.
RAW_COLUMNS = [
    "femaDeclarationString", "disasterNumber", "state", "declarationType",
    "declarationDate", "fyDeclared", "incidentType", "declarationTitle",
    "ihProgramDeclared", "iaProgramDeclared", "paProgramDeclared", "hmProgramDeclared",
    "incidentBeginDate", "incidentEndDate", "disasterCloseoutDate", "tribalRequest",
    "fipsStateCode", "fipsCountyCode", "placeCode", "designatedArea",
    "declarationRequestNumber", "lastIAFilingDate", "incidentId", "region",
    "designatedIncidentTypes", "lastRefresh", "hash", "id",
]

# Columns of the normalised table, in output order.
NORMALISED_COLUMNS = [
    "id", "femaDeclarationString", "disasterNumber", "state", "declarationType",
    "declarationTypeLabel", "declarationDate", "declarationYear", "declarationMonth",
    "declarationMonthName", "declarationQuarter", "declarationMonthYear", "fyDeclared",
    "incidentType", "declarationTitle", "designatedArea", "region", "femaRegion",
    "incidentBeginDate", "incidentEndDate", "disasterCloseoutDate", "ihProgramDeclared",
    "iaProgramDeclared", "paProgramDeclared", "hmProgramDeclared", "tribalRequest",
    "fipsStateCode", "fipsCountyCode", "placeCode", "declarationRequestNumber",
    "lastIAFilingDate", "incidentId", "designatedIncidentTypes", "lastRefresh",
]

# Column groups by treatment.
DATE_COLUMNS = [
    "declarationDate", "incidentBeginDate", "incidentEndDate",
    "disasterCloseoutDate", "lastIAFilingDate", "lastRefresh",
]
TEXT_COLUMNS = [
    "femaDeclarationString", "state", "declarationType", "incidentType",
    "declarationTitle", "designatedArea", "designatedIncidentTypes",
]
INTEGER_COLUMNS = [
    "disasterNumber", "fyDeclared", "ihProgramDeclared", "iaProgramDeclared",
    "paProgramDeclared", "hmProgramDeclared", "tribalRequest", "fipsStateCode",
    "fipsCountyCode", "placeCode", "declarationRequestNumber", "region",
]
REQUIRED_COLUMNS = [
    "disasterNumber", "state", "declarationType", "declarationDate",
    "incidentType", "designatedArea", "region",
]
FILLED_COLUMNS = ["state", "incidentType", "declarationTitle", "designatedArea"]

# Natural keys of the dimensions and columns of the fact table.
LOCATION_COLUMNS = [
    "state", "femaRegion", "region", "designatedArea",
    "fipsStateCode", "fipsCountyCode", "placeCode",
]
INCIDENT_COLUMNS = ["incidentType", "designatedIncidentTypes"]
FACT_COLUMNS = [
    "id", "femaDeclarationString", "disasterNumber", "declarationType", "declarationTitle",
    "fyDeclared", "ihProgramDeclared", "iaProgramDeclared", "paProgramDeclared",
    "hmProgramDeclared", "tribalRequest", "declarationRequestNumber", "incidentId",
    "dateKey", "locationKey", "incidentTypeKey", "declarationDate", "incidentBeginDate",
    "incidentEndDate", "disasterCloseoutDate", "lastIAFilingDate", "lastRefresh",
]

# Columns of the record listing and of the two forecast tables.
LISTING_COLUMNS = [
    "disasterNumber", "declarationDate", "state", "femaRegion", "incidentType",
    "declarationTypeLabel", "declarationTitle", "designatedArea",
]
FORECAST_COLUMNS = [
    "region", "month", "recordType", "declarationRecords", "lowerEstimate",
    "upperEstimate", "likelyIncidentType", "incidentTypeSupport",
    "incidentTypeConfidence", "likelyAreas", "method", "incidentTypeMethod",
    "incidentTypeLimitation", "generatedAt", "asOfDate", "trainingThrough",
    "forecastStart", "validationMae",
]
FORECAST_EXPORT_COLUMNS = [
    "region", "month", "recordType", "likelyIncidentType", "incidentTypeSupport",
    "incidentTypeConfidence", "likelyAreas", "declarationRecords", "lowerEstimate",
    "upperEstimate",
]
# A stored forecast without these columns is not served.
FORECAST_TYPE_COLUMNS = [
    "likelyIncidentType", "incidentTypeSupport", "incidentTypeConfidence",
    "likelyAreas", "incidentTypeMethod", "incidentTypeLimitation",
]

# The column that a table written by year is divided by.
YEAR_FOLDER = "year"

# Labels.
NOT_REPORTED = "Not Reported"
TYPE_LABELS = {
    "DR": "Major Disaster",
    "EM": "Emergency",
    "FM": "Fire Management Assistance",
}
REGION_NAMES = {
    "Region 1": "New England",
    "Region 2": "Northeast & Caribbean",
    "Region 3": "Mid-Atlantic",
    "Region 4": "Southeast",
    "Region 5": "Great Lakes",
    "Region 6": "South Central",
    "Region 7": "Central Plains",
    "Region 8": "Mountain",
    "Region 9": "Pacific Southwest & Islands",
    "Region 10": "Pacific Northwest",
}
REGION_AREAS = {
    "Region 1": "CT, ME, MA, NH, RI, VT",
    "Region 2": "NJ, NY, Puerto Rico, U.S. Virgin Islands",
    "Region 3": "DE, DC, MD, PA, VA, WV",
    "Region 4": "AL, FL, GA, KY, MS, NC, SC, TN",
    "Region 5": "IL, IN, MI, MN, OH, WI",
    "Region 6": "AR, LA, NM, OK, TX",
    "Region 7": "IA, KS, MO, NE",
    "Region 8": "CO, MT, ND, SD, UT, WY",
    "Region 9": "AZ, CA, HI, NV and Pacific territories",
    "Region 10": "AK, ID, OR, WA",
}
PREFERRED_REGIONS = ["Region 4", "Region 6", "Region 9"]
SEASONS = {
    "Winter": [12, 1, 2],
    "Spring": [3, 4, 5],
    "Summer": [6, 7, 8],
    "Fall": [9, 10, 11],
}
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# Text that means "missing" inside a text column.
NULL_TOKENS = ["", "nan", "NaN", "None", "<NA>"]
# Text a CSV field may hold for a missing value, in any column.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The forecast's settings.
SEASON_MONTHS = 12
TRAINING_MONTHS = 180
HOLDOUT_MONTHS = 12
BACKTEST_MINIMUM_MONTHS = 48
CATEGORY_HALF_LIFE = 60.0
REGRESSION_HALF_LIFE = 36.0
RIDGE = 0.12
HARMONICS = 3
SAME_MONTH_VALUES = 5
LEVEL_BOUNDS = (0.65, 1.35)
INTERVAL_WIDTH = 1.28
MAD_FACTOR = 1.4826
RMSE_FACTOR = 0.65
# Weight of (same month, neighbouring months) by least number of years seen.
BLEND = [(8, 0.70, 0.20), (4, 0.55, 0.25), (1, 0.40, 0.30), (0, 0.0, 0.45)]
NEIGHBOUR_AREA_WEIGHT = 0.35

# Texts of the forecast table.
REGRESSION_MODEL = "seasonal-trend regression"
SEASONAL_MODEL = "seasonal-naive benchmark"
NO_HISTORY = "Not enough history"
REGION_WIDE = "Region-wide"
STRONG = "Strong historical pattern"
MODERATE = "Moderate historical pattern"
LIMITED = "Limited historical pattern"
CATEGORY_METHOD = (
    "Recency-weighted regional month-of-year occurrence model using completed history"
)
CATEGORY_LIMITATION = (
    "Likely incident categories describe region-wide historical patterns. They do not "
    "predict a specific city, storm, or emergency."
)

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS])
