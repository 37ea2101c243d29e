"""Search templates: what the state buckets and the cross-state channels are asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.sources.registry import expanded, inline

#: The queries of each bucket of a state, in the order in which they are asked.
BUCKET_TEMPLATES = {
    "procurement": [
        '"{state}" state procurement RFP "occupational health" OR "employee health" OR "drug testing" 2025 OR 2026',
        '"{state}" state RFP bid "CDL medical" OR "DOT physical" OR "pre-employment exam" OR "workers comp medical"',
        '"{state}" state contract "public safety medical" OR "corrections health" OR "mobile medical" OR "fitness for duty"',
        '"{state}" NASPO cooperative contract occupational medicine health services 2025',
    ],
    "legislature": [
        '"{state}" state legislature bill occupational health workers compensation medical examination 2025 OR 2026',
        '"{state}" state legislation OSHA workplace safety bill proposed law 2025 2026',
        '"{state}" state bill telehealth CDL DOT drug testing medical examination law',
        '"{state}" NCSL state legislation health workforce occupational licensing bill tracking',
    ],
    "governor_agencies": [
        '"{state}" governor executive order health safety workforce 2025 2026',
        '"{state}" state agency announcement occupational health medical services press release',
        'site:usa.gov "{state}" state government agencies directory',
    ],
    "health_dept": [
        '"{state}" state health department alert bulletin outbreak notice 2025 OR 2026',
        '"{state}" department of health immunization vaccination policy update guidance',
        '"{state}" public health emergency notice clinic workforce rural health 2025',
        'ASTHO "{state}" state health official news announcement',
    ],
    "labor_warn": [
        '"{state}" WARN notice layoffs dislocated workers 2025 OR 2026',
        '"{state}" state workforce agency mass layoff employer notice DOL',
        '"{state}" labor department employer layoff closure workers compensation 2025',
        'BLS "{state}" employment data hiring labor market 2025 2026',
    ],
    "medical_licensing": [
        '"{state}" state medical board physician license discipline action 2025',
        '"{state}" medical board disciplinary notice revocation suspension 2025',
        'FSMB "{state}" medical licensing physician data 2025',
        '"{state}" nursing board license action NCSBN 2025',
    ],
    "emergency_mgmt": [
        '"{state}" state emergency management declaration disaster alert 2025 OR 2026',
        '"{state}" emergency declaration governor public health emergency disaster',
        '"{state}" FEMA disaster declaration emergency management agency notice',
        '"{state}" emergency operations center activation evacuation order 2025',
    ],
    "osha_plan": [
        '"{state}" state OSHA citation violation enforcement action 2025',
        '"{state}" workplace safety inspection fatality violation penalty 2025',
        '"{state}" OSHA state plan enforcement news industrial safety 2025',
        '"{state}" workplace injury illness data OSHA 300 log enforcement',
    ],
    "insurance_dept": [
        '"{state}" state insurance department bulletin order workers comp 2025',
        '"{state}" insurance commissioner order telehealth network adequacy 2025',
        'NAIC "{state}" insurance department notice regulation 2025',
        '"{state}" workers compensation rate change insurance regulatory 2025',
    ],
    "corrections": [
        '"{state}" state corrections department medical health services contract RFP 2025',
        '"{state}" department of corrections healthcare staffing inmate medical 2025',
        '"{state}" correctional health services contract bid vendor 2025 2026',
        '"{state}" jail prison health services nurse staffing contract',
    ],
    "fmcsa": [
        '"{state}" FMCSA DOT medical examiner certification CDL commercial driver physical 2025',
        '"{state}" DOT medical certificate CMV driver physical exam requirement 2025',
        'FMCSA "{state}" enforcement action carrier violation medical certification',
        '"{state}" CDL drug testing FMCSA clearinghouse commercial vehicle 2025',
    ],
    "post_guidelines": [
        '"{state}" POST commission law enforcement physical fitness medical standards 2025',
        '"{state}" police officer physical exam POST standard pre-employment',
        '"{state}" peace officer POST training standards physical fitness certification',
        '"{state}" law enforcement hiring physical medical exam entry standard',
    ],
    "dot": [
        '"{state}" department of transportation DOT infrastructure contract bid 2025 2026',
        '"{state}" DOT highway construction project contract award 2025',
        '"{state}" state DOT occupational health safety worker construction',
        '"{state}" transportation department RFP medical safety services 2025',
    ],
}
#: The queries of each channel that concerns all states.
CHANNEL_QUERIES = {
    "public_health": [
        "CDC Health Alert Network HAN notice public health alert 2025 2026",
        "site:emergency.cdc.gov health alert notice 2025",
        "state health alert network outbreak communicable disease alert 2025",
        "CDC CAHAN public health emergency occupational health alert 2025",
    ],
    "travel_advisory": [
        "CDC travel notice advisory health warning destination 2025 2026",
        "State Department travel advisory Level 3 OR Level 4 country 2025",
        "site:travel.state.gov travel advisory 2025",
        "CDC travel health notice disease outbreak destination 2025",
    ],
    "fda_recalls": [
        "FDA MedWatch safety alert medical device recall 2025 OR 2026",
        "FDA drug recall medication safety alert occupational health 2025",
        "site:fda.gov recall safety alert 2025 medical device drug",
        "FDA medical product safety communication 2025 urgent",
    ],
    "disaster": [
        "FEMA disaster declaration major disaster 2025 2026",
        "OpenFEMA disaster declaration state federal emergency 2025",
        "FEMA major disaster declaration DR- 2025 affected counties",
        "federal disaster declaration presidential emergency 2025 states affected",
    ],
}


def _listed(spark: SparkSession, groups: dict[str, list[str]], name: str) -> DataFrame:
    return inline(spark, f"{name} string, template int, text string", [(g, i, t) for g, texts in groups.items() for i, t in enumerate(texts, 1)])


def bucket_queries(states: DataFrame, state_name: str = "state_name", buckets: list[str] | None = None) -> DataFrame:
    """The columns of ``states`` with bucket, template and query, for all buckets or those named."""
    wanted = {b: t for b, t in BUCKET_TEMPLATES.items() if buckets is None or b in buckets}
    rows = expanded(_listed(states.sparkSession, wanted, "bucket"), states, "text", {"{state}": state_name})
    return rows.drop("text")


def channel_queries(spark: SparkSession) -> DataFrame:
    """(channel, template, query)."""
    return _listed(spark, CHANNEL_QUERIES, "channel").select("channel", "template", F.col("text").alias("query"))


def channel_searches(requests: DataFrame, channel: str) -> DataFrame:
    """Each request with the queries of its channel: template, query. A channel without any leaves no row."""
    return requests.join(channel_queries(requests.sparkSession).withColumnRenamed("channel", channel), channel)
