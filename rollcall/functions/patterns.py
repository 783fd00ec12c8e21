"""Word lists, patterns and labels that decide how records are read.

Patterns are written for Java regular expressions.  LEFT and RIGHT are ASCII word edges, since ``\\b`` counts
accented letters as word characters.
"""

LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def words(*alternatives: str) -> str:
    """Any of the alternatives as whole words, in any case."""
    return f"(?i){LEFT}(?:{'|'.join(alternatives)}){RIGHT}"


# --- fixed values -------------------------------------------------------------------------------------------------
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11,
    "november": 11, "dec": 12, "december": 12,
}
MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
DASH = "[-–—]"
OPEN_END = "current|present|tenure"

#: Dates in front of a text, and within it.
LEADING_DATE = (
    rf"(?i)^(?:(?:{MONTH})\s+\d{{1,2}},\s*\d{{4}}{RIGHT}|(?:{MONTH})\s+\d{{4}}{RIGHT}|\d{{4}}-\d{{2}}-\d{{2}}{RIGHT}|\d{{4}}\s*,\s*\d{{4}}{RIGHT}"
    rf"|\d{{4}}\s*{DASH}\s*(?:\d{{4}}|{OPEN_END}){RIGHT}|\d{{4}}{RIGHT})[\s,.:;-]*"
)
FULL_DATE = rf"({MONTH})\s+(\d{{1,2}}),\s*(\d{{4}})"
MONTH_YEAR = rf"({MONTH})\s+(\d{{4}})"
ISO_DATE = r"(\d{4})-(\d{2})-(\d{2})"
YEAR_RANGE = rf"((?:19|20)\d{{2}})\s*{DASH}\s*(?:(?:19|20)\d{{2}}|{OPEN_END})"
#: Numbers in front of a record; years and ranges inside one; a group's name in front of an entry.
LIST_NUMBER = r"^\s*\d+\s*[.)]\s*"
SOURCE_NUMBER = r"^\s*(?:\(\d+\)|\d+[.)])\s*"
YEARS = rf"(?i){LEFT}(?:19|20)\d{{2}}{RIGHT}(?:\s*(?:-|–|—|to)\s*(?:present|current|(?:19|20)\d{{2}}))?"
GROUP_PREFIX = r"(?i)^\s*(?:Current|Former)\s+(?:Ph\.?D\.?|Masters?|Postdoctoral|Staff|Undergraduate|Visiting)[^:]{0,80}:\s*"
FLAT_GROUP = r"(?s)^\s*([^:]{4,90}):\s*(.+)$"

SERVICE_PREFIXES = (
    "co[- ]?chair", "vice[- ]?chair", "chair", r"member(?:\s+of)?", "departmental", "campus", r"academic\s+senate", "senate", "university",
    "systemwide", "ucsd", r"uc\s+san\s+diego",
)
AUTHORSHIP_NOTES = ("co[- ]author", "co[- ]corresponding author", "corresponding author", "senior author")
CONTRIBUTION = rf"(?is)^(.*?)\s+(\*{{1,2}}\s*(?:{'|'.join(AUTHORSHIP_NOTES)})[^.]*\.?)$"
#: (all of these parts, heading), in order: the first row whose parts all occur decides.
GROUP_HEADINGS = (
    (("postdoctoral fellow", "current"), "Current Postdoctoral Associates"),
    (("undergraduate", "former"), "Former Undergraduate Research Students"),
    (("undergraduate",), "Undergraduate Research Students"),
    (("ph.d", "student"), "Former Ph.D. Students"),
    (("master", "student"), "Former Masters Students"),
    (("staff scientist",), "Current Staff Scientists"),
    (("visiting",), "Visiting Faculty/Students"),
)
IN_PROGRESS = ("submitted", "in progress", "under review", "in review", "under revision", "in preparation", "forthcoming")
SOURCE_IN_PROGRESS = ("submitted", "in progress", "under review", "in review")
BOOK_REVIEW = (("review of",), ("book", r"ed\.", r"eds\.", "john wiley", "press", "volume", r"vol\."))
REFEREED_PROCEEDINGS = (
    rf"{LEFT}proceedings{RIGHT}", rf"{LEFT}proc\.", rf"{LEFT}conference proceedings{RIGHT}", rf"{LEFT}conf\.?\s+proc\.?", rf"{LEFT}spie conference{RIGHT}",
    rf"{LEFT}rarefied gas dynamics{RIGHT}", rf"{LEFT}international{RIGHT}.{{0,80}}{LEFT}symposium{RIGHT}", rf"{LEFT}intl\.?\s+conf\.?",
    rf"{LEFT}j\.?\s*phys\.?\s*b\.?\s*conf\.?\s*proc\.?", rf"{LEFT}radiocarbon\s+\d+{RIGHT}",
)
CONFERENCE = ("conference", "symposium", "meeting", "workshop", "proceedings", "proc\\.")
WIDE_AUDIENCE = (
    "conference", "congress", "symposium", "workshop", "meeting", "colloquium", "gordon", "faraday", "acs", "aps", "aiche", "international", "national",
    "world", "society", "division",
)
HONORIFIC = ("visiting scientist", "professore visitatore", "visiting professor", "visiting scholar", "scholar", "fellow")
ORDINARY_POST = (
    "postdoctoral", "research assistant", "assistant professor", "associate professor", "professor, department", "chemist", "scientist, gas", "staff scientist",
)
NOT_EMPLOYMENT = ("visiting", "visitatore", "fellow", "scholar", "chair", "vice chancellor", "senate", "council", "committee")
ACADEMIC_RANK = (
    "assistant professor", "associate professor", "professor", "postdoctoral", "research assistant", "chemist", "lecturer", "instructor", "scientist",
)
MENTORING = (
    "student", "advisee", "thesis", "dissertation", "committee", "mentor", "supervis", "postdoc", "postdoctoral", "undergraduate", "graduate", "visitor",
    "visiting", "staff scientist",
)
HIDDEN_NOTE = (r"source\s+no\.?", r"review\s+material")
NOT_RENDERED_TALKS = ("(poster)", "poster presentation", "contributed talk")
#: In order of preference for a record whose copies differ in type.
PUBLICATION_TYPES = ("journal", "review", "book", "chapter", "proceedings", "abstract", "popular", "other")
SERVICE_CATEGORIES = ("departmental", "college", "campus", "university", "senate", "systemwide", "other")
SEVERITIES = ("required", "recommended", "optional")
ARTICLE_KINDS = {"research": "Research article", "review": "Review article", "creative": "Creative work"}
PRIMARY_BUCKETS = ("peerReviewedJournals", "reviewAndInvited", "books", "chapters", "refereedProceedings", "otherArticles")
PUBLICATION_BUCKETS = (
    *PRIMARY_BUCKETS, "otherProceedings", "abstracts", "popularWorks", "additionalProducts", "theses", "patents", "workInProgress",
)
STRING_BUCKETS = (
    "publicService", "professionalActivities", "memberships", "awards", "teaching", "studentInstructionalActivities", "externalProfessionalActivities",
    "consulting", "reviewerActivities", "presentations", "invitedPresentations", "diversityContributions", "outreach", "clinicalActivities",
    "otherActivities", "externalReviews",
)
APPENDIX_HEADING = "Conversion Review Summary"
APPENDIX_INTRO = "This page lists items the automated conversion could not complete or was unsure how to place."
NOT_LISTED = "Not listed"
#: Where a record may also stand: its section's name in a note, and the bucket, in the order in which repeats are looked for.
ACTIVITY_SECTIONS = (
    ("Section II: Professional Activities", "professionalActivities"), ("Section II: External Professional Activities", "externalProfessionalActivities"),
    ("Section II: Reviewer Activities", "reviewerActivities"), ("Section II: Presentations at National and International Meetings", "presentations"),
    ("Section II: Other Invited Presentations", "invitedPresentations"), ("Section II: Student Instructional Activities", "studentInstructionalGroups"),
    ("Section II: Student Instructional Activities", "studentInstructionalActivities"),
)
PUBLICATION_SECTIONS = (
    ("Section III.A.I Refereed Journal Articles", "peerReviewedJournals"), ("Section III.A.II Review and Invited Articles", "reviewAndInvited"),
    ("Section III.A.III Books", "books"), ("Section III.A.III Book Chapters", "chapters"), ("Section III.A.IV Refereed Conference Proceedings", "refereedProceedings"),
    ("Section III.A.V Other Articles", "otherArticles"), ("Section III.B.I Other Conference Proceedings", "otherProceedings"), ("Section III.B.II Abstracts", "abstracts"),
    ("Section III.B.III Popular Works", "popularWorks"),
)
#: Section, topic and the words before the record, of the three kinds of notes.
CONFLICT_NOTE = (
    "Section II: University Service; Section II: External Professional Activities", "Potential duplicate placement",
    "Review the differing date or wording before choosing one placement: ")
ACTIVITY_NOTE = ("Potential duplicate placement", "Review whether this item should appear in both sections or only one: ")
PUBLICATION_NOTE = ("Potential duplicate bibliography placement", "Review whether this citation should appear in both sections or only one: ")
