"""Fixed vocabularies: field concepts, stop words, topics, routing terms. Order matters where the first match wins."""

from __future__ import annotations

# Concept of a column by the first pattern that its lower-cased name matches.
CONCEPTS = {
    "organization": [r"organ", r"company", r"entity", r"authority"],
    "subsidiary": [r"subsidiar", r"coal company", r"ccl", r"bccl", r"ecl", r"ncl", r"wecl", r"secl", r"mcl", r"cil"],
    "mine": [r"\bmine\b", r"colliery", r"opencast", r"oc\b", r"pit\b"],
    "coalfield": [r"coalfield", r"coal field"],
    "block": [r"\bblock\b", r"lease block"],
    "project": [r"project", r"scheme"],
    "state": [r"\bstate\b", r"province"],
    "district": [r"district", r"tehsil"],
    "financial_year": [r"fin.*year", r"fy\b", r"financial year", r"fiscal"],
    "reporting_period": [r"report.*period", r"period", r"quarter", r"month", r"year"],
    "production": [r"produc", r"\bprod\.?\b", r"output"],
    "target": [r"target", r"plan", r"budget"],
    "dispatch": [r"dispatch", r"despatch", r"offtake", r"supply", r"sales"],
    "grade": [r"\bgrade\b", r"quality", r"ash\b", r"gcv", r"grc"],
    "seam": [r"\bseam\b"],
    "seam_thickness": [r"seam.*thick", r"thickness"],
    "borehole": [r"borehole", r"bore hole", r"bh\b", r"drill"],
    "borehole_depth": [r"depth", r"bore.*depth"],
    "exploration": [r"explor"],
    "resource": [r"resource", r"geological reserve"],
    "reserve": [r"\breserve\b", r"minable", r"proved"],
    "latitude": [r"lat\b", r"latitude"],
    "longitude": [r"lon\b", r"long\b", r"longitude"],
    "coordinates": [r"coord", r"location", r"easting", r"northing"],
    "survey": [r"survey"],
    "seismic": [r"seismic", r"geophysic"],
    "unit": [r"\bunit\b", r"uom", r"measure"],
    "remarks": [r"remark", r"note", r"comment"],
}
# Field names that are numeric, and those that are dimensions, whatever their content.
NUMERIC_FIELDS = ("production", "target", "dispatch", "reserve", "resource", "seam_thickness", "borehole_depth", "depth", "count", "value", "amount")
DIMENSIONS = ("subsidiary", "mine", "coalfield", "block", "project", "state", "district", "financial_year", "reporting_period", "month", "coal_type", "grade", "status", "organization")
OPTION_FIELDS = ("subsidiary", "mine", "state", "district", "coalfield", "financial_year", "reporting_period", "month", "coal_type", "grade", "project", "status")
# Concepts whose cells are normalised to numbers; those that validation checks, and of which a negative one is suspicious.
MEASURED = ("production", "target", "dispatch", "resource", "reserve", "seam_thickness", "borehole_depth")
CHECKED = ("production", "target", "dispatch", "resource", "reserve")
NON_NEGATIVE = ("production", "target", "dispatch")
# Unit names, first match wins.
UNITS = [(r"\bmt\b|million ?tonnes?", "MT"), (r"\bkt\b|000 ?t|thousand ?tonnes?", "MT"), (r"\btonnes?\b|\bt\b", "MT"), (r"\bkg\b", "MT"), (r"\bkm\b", "km"), (r"\bm\b", "m"), (r"%|percent", "%")]
# Words that ranking ignores.
RANK_STOP = [
    "a", "an", "the", "in", "on", "at", "of", "for", "to", "from", "by", "with", "about", "into", "through", "during", "before", "after", "above",
    "below", "under", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "and", "or", "but", "if",
    "because", "as", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "it", "its", "they", "them", "their",
]
# Words that topics ignore.
TOPIC_STOP = [
    "a", "an", "the", "in", "on", "at", "of", "for", "to", "from", "by", "with", "about", "into", "through", "during", "before", "after", "above",
    "below", "under", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "and", "or", "but", "if",
    "because", "as", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "it", "its", "they", "them", "their", "we", "our", "he",
    "she", "his", "her", "will", "shall", "may", "can", "not", "no", "nor", "also", "such", "than", "then", "so", "yet", "both", "each", "more",
    "most", "other", "some", "any", "all", "report", "chapter", "page", "table", "figure", "annexure", "appendix", "section", "part", "year",
    "period", "total", "overall", "various", "number", "per", "cent", "percentage", "up", "down", "over", "out", "off", "made", "given", "including",
    "however", "therefore", "accordingly", "whereas", "therein", "thereof", "herein", "hereby", "thus", "viz", "etc", "respectively", "said", "duly",
    "within", "without", "along", "across", "further", "due", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "lakh", "crore", "million", "billion",
]
# Keywords of each topic.
TOPICS = {
    "Geological Exploration": [
        "exploration", "borehole", "drilling", "geological", "seismic", "geophysics", "stratigraphy", "mapping", "toposheet", "survey", "block",
        "reserve", "resource", "estimation", "fsp", "gsi",
    ],
    "Coal Production": [
        "production", "mining", "excavation", "overburden", "extraction", "opencast", "underground", "longwall", "depillaring", "dispatch",
        "raising", "output", "tonnes", "mt",
    ],
    "Coal Quality & Grades": [
        "coking", "non-coking", "grade", "ash", "moisture", "gcv", "washery", "beneficiation", "quality", "thermal", "power", "blending", "washed",
        "middling",
    ],
    "Environment & Safety": [
        "environment", "environmental", "safety", "clearance", "pollution", "effluent", "reclamation", "afforestation", "subsidence", "accident",
        "rescue", "rehabilitation", "impact", "compliance", "ecology",
    ],
    "Infrastructure & Projects": [
        "railway", "transport", "siding", "conveyor", "project", "capital", "expenditure", "investment", "infrastructure", "capacity", "expansion",
        "modernisation", "mechanisation",
    ],
    "Subsidiaries & Operations": [
        "cil", "cmpdi", "ecl", "bccl", "ccl", "ncl", "secl", "wcl", "mcl", "sccl", "subsidiary", "coalfield", "jharia", "raniganj", "singrauli",
        "talcher", "korba", "wardha",
    ],
    "Planning & Policy": [
        "policy", "regulation", "ministry", "parliament", "committee", "plan", "target", "achievement", "performance", "review", "annual", "budget",
        "allocation",
    ],
}
# Names by which a question means a subsidiary; the first that occurs wins.
SUBSIDIARIES = {
    "MCL": ["mcl", "mahanadi coalfields", "mahanadi"], "ECL": ["ecl", "eastern coalfields"], "BCCL": ["bccl", "bharat coking coal"],
    "CCL": ["ccl", "central coalfields"], "WCL": ["wcl", "western coalfields"], "SECL": ["secl", "south eastern coalfields"],
    "NCL": ["ncl", "northern coalfields"], "CMPDI": ["cmpdi", "central mine planning"], "CIL": ["cil", "coal india"], "NEC": ["nec", "north eastern coalfields"],
}
# Words by which a question asks for an aggregate or a metric, and patterns of its intent.
AGGREGATIONS = {
    "max": ["highest", "maximum", "max", "most", "top", "peak", "greatest"],
    "min": ["lowest", "minimum", "min", "least", "bottom", "smallest"],
    "sum": ["total", "sum", "overall", "aggregate", "combined"],
    "avg": ["average", "mean", "avg"],
}
METRICS = {
    "production_target": ["production target", "target production", "planned production", "production goal", "target"],
    "achievement": ["achievement percentage", "achievement percent", "target achievement", "achievement"],
    "dispatch": ["total dispatch", "total offtake", "dispatch", "dispatched", "offtake", "supply"],
    "sales": ["sales", "revenue", "turnover"],
    "pbt": ["pbt", "profit before tax"],
    "pat": ["pat", "profit after tax"],
    "eps": ["eps", "earning per share", "earnings per share"],
    "dividend": ["dividend"],
    "capex": ["capex", "capital expenditure"],
    "net_worth": ["net worth", "networth"],
    "overburden": ["overburden removal", "overburden", "ob removal", "stripping"],
    "production": ["total production", "production", "produced", "output", "extracted", "mining output", "how much was produced"],
    "reserve": ["reserve", "reserves", "resources", "geological reserve"],
    "grade": ["coal grade", "grade", "gcv", "calorific", "ash content"],
    "borehole": ["borehole", "drilling", "meterage", "seam"],
}
NARRATIVE = [
    r"\baccording to\b", r"\bas per\b", r"\breport\b", r"\bannual report\b", r"\bexplain\b", r"\bdescribe\b", r"\boverview\b", r"\bservices?\b",
    r"\bactivities\b", r"\bwhat does .* say\b", r"\bwhy\b", r"\bdetails\b", r"\bmethodology\b", r"\bfindings\b", r"\bpolicy\b", r"\bguidelines?\b",
]
COMPARISON = [
    r"\bcompar\w*\b", r"\bvs\b", r"\bversus\b", r"\bagainst\b", r"\bdifference\b", r"\bchange\b", r"\byear.on.year\b", r"\byoy\b", r"\bgrowth\b",
    r"\bimprovement\b", r"\bwhat\s+is\s+new\b", r"\bhow\s+much\s+(?:did|has)\s+.*(?:increase|decrease|grow|change)\b", r"\bpichl\w*\b",
    r"\bprevious\s+record\w*\b", r"\bloaded\s+record\w*\b", r"\bmatch\s+kiya\b", r"\bkitna\s+(?:kam|jyada|zyada)\b", r"\bkam\s+hai\b", r"\bjyada\s+hai\b",
]
ORGANIZATION = [
    r"\borganization\b", r"\bhistor\w*\b", r"\bbaseline\b", r"\breference\s+data\b", r"\bpast\s+report\b", r"\bpast\s+data\b", r"\bprevious\s+period\b",
    r"\bprevious\s+year\b", r"\blast\s+year\b", r"\bpichla\s+record\b", r"\bpichle\s+record\b", r"\bsystem\s+me\s+loaded\b",
]
# Fields a question can ask for, with the patterns that ask for them.
ASKED = {
    "mine_name": [r"\bmine\s+name\b", r"\bname\s+of\s+(?:the\s+)?mine\b", r"\bmine's\s+name\b", r"\bwhich\s+mine\b"],
    "location": [r"\blocation\b", r"\bwhere\s+(?:is|was)\s+(?:the\s+)?(?:mine|it)\s+located\b", r"\blocated\b", r"\bplace\b", r"\bdistrict\b", r"\bstate\b"],
    "mine_type": [r"\bmine\s+type\b", r"\btype\s+of\s+(?:the\s+)?mine\b"],
    "production_target": [r"\bproduction\s+target\b", r"\btarget\s+production\b", r"\btarget\b", r"\bplanned\s+production\b"],
    "production": [r"\bproduction\b", r"\bproduced\b", r"\boutput\b", r"\bhow\s+much\s+was\s+produced\b", r"\bcoal\s+production\b"],
    "dispatch": [r"\bdispatch\b", r"\bofftake\b", r"\bsupply\b"],
    "achievement": [r"\bachievement\b", r"\btarget\s+achievement\b"],
    "coal_grade": [r"\bcoal\s+grade\b", r"\bgrade\s+of\s+coal\b", r"\bgrade\b", r"\bgcv\b", r"\bcalorific\b"],
    "year": [r"\byear\b", r"\breporting\s+year\b", r"\bfinancial\s+year\b", r"\bfy\b", r"\bperiod\b"],
    "overburden": [r"\boverburden\s+removal\b", r"\boverburden\b", r"\bob\s+removal\b", r"\bstripping\b"],
    "sales": [r"\bsales\b", r"\brevenue\b", r"\bturnover\b", r"\bnet\s+sales\b"],
    "pbt": [r"\bpbt\b", r"\bprofit\s+before\s+tax\b"],
    "pat": [r"\bpat\b", r"\bprofit\s+after\s+tax\b"],
    "capex": [r"\bcapex\b", r"\bcapital\s+expenditure\b"],
    "net_worth": [r"\bnet\s*worth\b", r"\bnetworth\b"],
    "eps": [r"\beps\b", r"\bearnings?\s+per\s+share\b"],
    "dividend": [r"\bdividends?\b"],
    "reserve": [r"\breserves?\b", r"\bgeological\s+reserve\b", r"\bresources\b"],
    "employee_count": [r"\bemployee\s+count\b", r"\bnumber\s+of\s+employees\b", r"\bemployees?\b", r"\bworkforce\b", r"\bmanpower\b", r"\bheadcount\b"],
}
# Fields that a text describes rather than a table; "all details" asks for these ten.
DESCRIPTIVE = ("mine_name", "location", "mine_type", "reserve")
ALL_DETAILS = [r"\ball(?:\s+available)?\s+mining\s+details\b", r"\ball(?:\s+available)?\s+details\b"]
ALL_FIELDS = ("mine_name", "location", "mine_type", "production", "production_target", "dispatch", "achievement", "coal_grade", "year", "overburden")
# Fields whose all-capitals values are names.
NAME_FIELDS = ("mine", "subsidiary", "organization", "district", "state", "coalfield")
IMPORTANT_FIELDS = ("production", "financial_year", "mine", "subsidiary", "organization")
