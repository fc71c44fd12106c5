"""Label tables, standard dimensions and reader layouts the results depend on."""

from __future__ import annotations

from stratalens.operators.strata import Dimension

# The thirteen standard dimensions and the base table each is rolled up from.
STANDARD_DIMENSIONS = (
    Dimension("Country × Gender × Age", ("country", "gender", "age_group"), (), "Fine-grained demographic representativeness", "age_gender"),
    Dimension("Country × Religion", ("country", "religion"), (), "Religious representativeness by country", "religion"),
    Dimension("Country × Environment", ("country", "environment"), (), "Urban/rural representativeness by country", "environment"),
    Dimension("Country", ("country",), (), "Country-level representativeness", "age_gender"),
    Dimension("Region × Gender × Age", ("region", "gender", "age_group"), ("country_to_region",), "Regional demographic representativeness", "age_gender"),
    Dimension("Region × Religion", ("region", "religion"), ("country_to_region",), "Regional religious representativeness", "religion"),
    Dimension("Region × Environment", ("region", "environment"), ("country_to_region",), "Regional urban/rural representativeness", "environment"),
    Dimension("Region", ("region",), ("country_to_region",), "Regional representativeness", "age_gender"),
    Dimension("Continent", ("continent",), ("country_to_continent",), "Continental representativeness", "age_gender"),
    Dimension("Religion", ("religion",), (), "Global religious representativeness", "religion"),
    Dimension("Environment", ("environment",), (), "Global urban/rural representativeness", "environment"),
    Dimension("Age Group", ("age_group",), (), "Global age representativeness", "age_gender"),
    Dimension("Gender", ("gender",), (), "Global gender representativeness", "age_gender"),
)

# Raw population age columns that make up each age group.
AGE_COLUMNS = {
    "18-25": ["15-19", "20-24"],
    "26-35": ["25-29", "30-34"],
    "36-45": ["35-39", "40-44"],
    "46-55": ["45-49", "50-54"],
    "56-65": ["55-59", "60-64"],
    "65+": ["65-69", "70-74", "75-79", "80-84", "85-89", "90-94", "95-99", "100+"],
}

# Raw percentage columns that make up each religion.
RELIGION_COLUMNS = {
    "Christianity": ["PERCENT CHRISTIAN"],
    "Islam": ["PERCENT MUSLIM"],
    "Hinduism": ["PERCENT HINDU"],
    "Buddhism": ["PERCENT BUDDHIST"],
    "Judaism": ["PERCENT JEWISH"],
    "I do not identify with any religious group or faith": ["PERCENT UNAFFIL."],
    "Other religious group": ["PERCENT FOLK RELIGION", "PERCENT OTHER RELIGION"],
}

# Raw columns in thousands of people per kind of place.
SETTING_COLUMNS = {"Urban": "Urban (thousands)", "Rural": "Rural (thousands)"}

# Row types that are countries, names that are aggregates, words that mark one.
COUNTRY_TYPES = ("Country", "Country/Area")
RELIGION_AGGREGATES = (
    "Asia-Pacific", "Europe", "Latin America-Caribbean", "Sub-Saharan Africa", "North America", "South America",
    "Africa", "Asia", "Oceania", "WORLD", "More developed regions", "Less developed regions", "World",
)
SETTING_AGGREGATES = (
    "WORLD", "More developed regions", "Less developed regions", "World", "Africa", "Asia", "Europe",
    "North America", "South America", "Oceania", "Eastern Africa", "Western Africa", "Middle Africa",
    "Northern Africa", "Southern Africa", "Eastern Asia", "South-eastern Asia", "Southern Asia", "Western Asia",
    "Central Asia", "Eastern Europe", "Northern Europe", "Southern Europe", "Western Europe", "Caribbean",
    "Central America", "Northern America", "Australia and New Zealand", "Melanesia", "Micronesia", "Polynesia",
    "Least Developed Countries", "Less developed countries", "Lower-middle-income countries",
    "Upper-middle-income countries", "High-income countries", "Low-income countries",
)
AGGREGATE_WORDS = ("region", "developed", "income", "countries")

# Question texts of the participant export and the columns they become.
QUESTION_COLUMNS = {
    "How old are you?": "age_group",
    "What is your gender?": "gender",
    "What best describes where you live?": "environment",
    "What religious group or faith do you most identify with?": "religion",
    "What country or region do you most identify with?": "country",
    "Participant Id": "participant_id",
}
# The same export by position, and by word in its unquoted form.
EXPORT_POSITIONS = {"participant_id": 2, "age_group": 5, "gender": 6, "environment": 7, "religion": 9, "country": 10}
WORD_POSITIONS = {"participant_id": 0, "age_group": 5, "gender": 6, "environment": 7, "religion": 9, "country": 10}
WORDS_NEEDED = 11
CORE_COLUMNS = ("country", "gender", "age_group")

# Accepted spellings per column; anything else becomes null.
SYNONYMS = {
    "age_group": {
        "18-25": "18-25", "26-35": "26-35", "36-45": "36-45", "46-55": "46-55", "56-65": "56-65",
        "65+": "65+", "65 or older": "65+", "Over 65": "65+",
    },
    "gender": {"Male": "Male", "Female": "Female", "Man": "Male", "Woman": "Female"},
    "environment": {
        "Urban": "Urban", "Suburban": "Urban", "Rural": "Rural", "City": "Urban", "Town": "Urban",
        "Village": "Rural", "Countryside": "Rural",
    },
    "religion": {
        "Christianity": "Christianity", "Christian": "Christianity", "Islam": "Islam", "Muslim": "Islam",
        "Hinduism": "Hinduism", "Hindu": "Hinduism", "Buddhism": "Buddhism", "Buddhist": "Buddhism",
        "Judaism": "Judaism", "Jewish": "Judaism",
        "I do not identify with any religious group or faith": "I do not identify with any religious group or faith",
        "No religion": "I do not identify with any religious group or faith",
        "Atheist": "I do not identify with any religious group or faith",
        "Agnostic": "I do not identify with any religious group or faith",
        "None": "I do not identify with any religious group or faith",
        "Other": "Other religious group", "Other religious group": "Other religious group",
    },
}
# Country spellings; countries not listed keep theirs.
COUNTRY_SPELLINGS = {
    "United States": "United States", "USA": "United States", "US": "United States",
    "United States of America": "United States", "UK": "United Kingdom", "Britain": "United Kingdom",
    "Great Britain": "United Kingdom",
}

# Numeric answers of the coded survey.
SEX_CODES = {1: "Male", 2: "Female"}
PLACE_CODES = {1: "Urban", 2: "Rural"}
RELIGION_CODES = {
    0: "No religious denomination", 1: "Roman Catholic", 2: "Protestant", 3: "Orthodox", 4: "Jew", 5: "Muslim",
    6: "Hindu", 7: "Buddhist", 8: "Other", -1: "No answer", -2: "No answer",
}
# Year in which each wave of the coded survey counts.
WAVE_YEARS = {6: 2014, 7: 2022}

# Standard categories and the raw values they collect, per source and attribute.
SEGMENT_MAPPINGS = {
    "benchmark": {
        "age_group": AGE_COLUMNS,
        "gender": {"Male": ["Male", "male"], "Female": ["Female", "female"]},
        "religion": {
            "Christianity": ["Christianity", "Christian"],
            "Islam": ["Islam", "Muslim"],
            "Hinduism": ["Hinduism", "Hindu"],
            "Buddhism": ["Buddhism", "Buddhist"],
            "Judaism": ["Judaism", "Jewish"],
            "I do not identify with any religious group or faith": ["Unaffiliated", "None", "No religion"],
            "Other religious group": ["Other", "Folk religion", "Other religions"],
        },
        "environment": {"Urban": ["Urban"], "Rural": ["Rural"]},
        "country": {
            "United States of America": ["United States of America", "USA", "US", "United States"],
            "United Kingdom": ["United Kingdom", "UK", "Great Britain", "Britain"],
            "Republic of Korea": ["Republic of Korea", "Korea, Republic of", "Korea South", "South Korea"],
            "Dem. People's Republic of Korea": [
                "Democratic People's Republic of Korea", "Korea, Democratic People's Republic of", "Korea North", "North Korea",
            ],
            "Russian Federation": ["Russian Federation", "Russia"],
            "Iran": ["Iran (Islamic Republic of)", "Iran, Islamic Republic of", "Iran"],
            "Venezuela": ["Venezuela (Bolivarian Republic of)", "Venezuela, Bolivarian Republic of", "Venezuela"],
            "Syria": ["Syrian Arab Republic", "Syria"],
            "Tanzania": ["United Republic of Tanzania", "Tanzania, United Republic of", "Tanzania"],
            "Moldova": ["Republic of Moldova", "Moldova, Republic of", "Moldova"],
            "Bolivia": ["Bolivia (Plurinational State of)", "Bolivia, Plurinational State of", "Bolivia"],
            "Laos": ["Lao People's Democratic Republic", "Lao PDR", "Laos"],
            "Viet Nam": ["Viet Nam", "Vietnam"],
            "State of Palestine": ["State of Palestine", "Palestinian Territory", "Palestine, State of", "Palestine"],
            "Türkiye": ["Türkiye", "Turkey", "Turkiye"],
            "Saint Vincent and the Grenadines": [
                "Saint Vincent and the Grenadines", "Saint Vincent & the Grenadines", "St. Vincent and the Gren.",
            ],
            "Ireland": ["Ireland", "Ireland {Republic}", "Republic of Ireland"],
        },
    },
    "participants": {
        "age_group": {
            "18-25": ["18-25"], "26-35": ["26-35"], "36-45": ["36-45"], "46-55": ["46-55"], "56-65": ["56-65"], "65+": ["65+"],
        },
        "gender": {"Male": ["Male", "male"], "Female": ["Female", "female"]},
        "religion": {
            "Christianity": ["Christianity"],
            "Islam": ["Islam"],
            "Hinduism": ["Hinduism"],
            "Buddhism": ["Buddhism"],
            "Judaism": ["Judaism"],
            "I do not identify with any religious group or faith": ["I do not identify with any religious group or faith"],
            "Other religious group": ["Other religious group", "Sikhism"],
        },
        "environment": {"Urban": ["Urban"], "Rural": ["Rural"]},
    },
    "coded": {
        "age_group": {
            "18-25": ["18-24", "18-29"], "26-35": ["25-29", "30-34"], "36-45": ["35-39", "40-44"],
            "46-55": ["45-49", "50-54"], "56-65": ["55-59", "60-64"], "65+": ["65+", "65-69", "70+"],
        },
        "gender": {"Male": ["1", "Male"], "Female": ["2", "Female"]},
        "religion": {
            "Christianity": ["1", "2", "3"], "Islam": ["5"], "Hinduism": ["6"], "Buddhism": ["7"], "Judaism": ["4"],
            "I do not identify with any religious group or faith": ["0", "12"],
            "Other religious group": ["8", "9", "10", "11"],
        },
    },
}
# Attributes a source takes over from another source.
SEGMENT_INHERITS = (("participants", "country", "benchmark"),)
