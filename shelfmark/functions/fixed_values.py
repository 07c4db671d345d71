"""Fixed values of the retail model, stated as they are."""

#: Reporting region of each state, territory and freely associated state, by its postal abbreviation.
REGION_STATES = {
    "Northeast": ("CT", "ME", "MA", "NH", "RI", "VT", "NJ", "NY", "PA"),
    "Midwest": ("IL", "IN", "MI", "OH", "WI", "IA", "KS", "MN", "MO", "NE", "ND", "SD"),
    "South": ("DE", "FL", "GA", "MD", "NC", "SC", "VA", "WV", "DC", "AL", "KY", "MS", "TN", "AR", "LA", "OK", "TX"),
    "West": ("AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY", "AK", "CA", "HI", "OR", "WA"),
    "US Territories": ("PR", "VI", "AS", "GU", "MP"),
    "Freely Associated States": ("FM", "MH", "PW"),
}

#: Accepted spellings of a date; the time of day is dropped.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "MM/dd/yyyy")

TRUE_WORDS = ("true", "t", "1", "yes", "y")
FALSE_WORDS = ("false", "f", "0", "no", "n")

#: Bounds of a version that has always held and of one that still holds.
FIRST_START = "1900-01-01 00:00:00"
OPEN_END = "9998-12-31 00:00:00"

#: The key of the default member of a dimension.
UNKNOWN_KEY = -1
