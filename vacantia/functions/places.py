"""Names of countries, states and cities that filters look for in locations as written (fixed values)."""

from __future__ import annotations

#: The states of the United States and the capital's district: code and name, of ISO 3166-2.
US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado",
    "CT": "Connecticut", "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii",
    "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky",
    "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio",
    "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}

#: How a filter may name the United States.
US_KEYS = ("united states", "usa", "us", "u.s.", "u.s.a.")

#: Words by which a location says that it is in the United States.
US_TERMS = ("united states", "usa", "u.s.", "u.s.a.", "us remote", "remote us", "remote - us", "remote-us", "u.s. remote", "remote - u.s.")

#: Cities that stand for the United States without a state.
US_CITIES = (
    "san francisco", "new york", "new york city", "boston", "chicago", "los angeles", "seattle", "austin", "denver", "atlanta",
    "miami", "dallas", "houston", "phoenix", "san diego", "san jose", "washington", "washington dc", "washington d.c.", "baltimore",
    "boulder", "pittsburgh", "cincinnati", "des moines", "menlo park", "mountain view", "redwood city", "palo alto", "redmond",
    "long beach", "cape canaveral", "starbase", "bastrop", "hawthorne", "mcgregor", "provo", "charlotte", "raleigh", "durham",
    "somerville", "billerica", "framingham", "quincy", "lexington", "waltham", "reston", "mclean", "irvine", "costa mesa",
    "santa ana", "san carlos", "foster city", "south san francisco", "sunnyvale", "los altos", "tucson", "albuquerque", "st. louis", "saint louis",
)

#: Countries that a filter may name, with their codes.
COUNTRY_CODES = {
    "argentina": "AR", "australia": "AU", "belgium": "BE", "brazil": "BR", "bulgaria": "BG", "canada": "CA", "chile": "CL", "colombia": "CO",
    "croatia": "HR", "cyprus": "CY", "czechia": "CZ", "denmark": "DK", "finland": "FI", "france": "FR", "germany": "DE", "hungary": "HU",
    "india": "IN", "ireland": "IE", "israel": "IL", "japan": "JP", "lithuania": "LT", "malta": "MT", "mexico": "MX", "netherlands": "NL",
    "nigeria": "NG", "poland": "PL", "romania": "RO", "singapore": "SG", "slovakia": "SK", "south korea": "KR", "spain": "ES", "sweden": "SE",
    "taiwan": "TW", "united arab emirates": "AE", "united kingdom": "GB", "united states": "US", "uruguay": "UY",
}

#: Other spellings of some of them.
COUNTRY_ALIASES = {
    "united kingdom": ("united kingdom", "uk", "u.k.", "england", "scotland", "wales", "northern ireland", "britain", "great britain"),
    "ireland": ("ireland", "ie"),
    "czechia": ("czechia", "czech republic"),
    "south korea": ("south korea", "korea"),
    "netherlands": ("netherlands", "the netherlands"),
    "united arab emirates": ("united arab emirates", "uae"),
}

#: Locations that name no place.
NO_PLACE = ("", "remote", "hybrid", "distributed", "in-office", "in office", "n/a", "worldwide", "home based - worldwide", "water/ww")
