"""Fixed values of record consolidation: source trust, agreement scores, aliases, headings, countries."""

from __future__ import annotations

import json

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------------------------------------------
SOURCES = ("ATS", "Resume", "GitHub")
METHODS = {"ATS": "direct_mapping", "Resume": "ocr_extraction", "GitHub": "api_fetch"}
BASE_CONFIDENCE = {"ATS": 0.95, "Resume": 0.85, "GitHub": 0.80}
PRIORITY = {"ATS": 3, "Resume": 2, "GitHub": 1}
#: A source's bit in a set of sources.
BIT = {"ATS": 4, "Resume": 2, "GitHub": 1}
UNKNOWN_CONFIDENCE = 0.80
INVALID_CONFIDENCE = 0.20
#: Confidence of a set of agreeing sources, by the sum of their bits.
AGREEMENT = {7: 1.00, 6: 0.98, 5: 0.97, 4: 0.95, 3: 0.93, 2: 0.85, 1: 0.80, 0: 0.0}
FUZZY_SKILL = 82.0
FUZZY_COMPANY = 85.0
FUZZY_TITLE = 80.0
FUZZY_INSTITUTION = 85.0

FIELD_ALIASES: dict[str, list[str]] = {
    "full_name": ["full_name", "name", "candidate_name", "applicant_name", "fullName", "candidateName", "applicantName", "contact_name", "firstName_lastName", "display_name"],
    "emails": ["emails", "email", "email_address", "emailAddress", "contact_email", "primary_email", "email_id"],
    "phones": ["phones", "phone", "phone_number", "phoneNumber", "contact_phone", "mobile", "cell", "mobile_number", "telephone", "tel", "contact_number"],
    "location": ["location", "address", "current_location", "currentLocation", "city", "city_state", "residence", "home_address"],
    "headline": ["headline", "title", "job_title", "current_title", "position", "jobTitle", "current_position", "role", "designation", "professional_title"],
    "years_experience": ["years_experience", "years_of_experience", "experience_years", "yearsOfExperience", "total_experience", "exp_years", "work_experience_years"],
    "skills": ["skills", "skill_set", "skillSet", "technical_skills", "technicalSkills", "competencies", "key_skills", "technologies", "tech_stack", "expertise"],
    "experience": ["experience", "work_experience", "workExperience", "employment_history", "employmentHistory", "jobs", "work_history", "career_history"],
    "education": ["education", "education_history", "educationHistory", "qualifications", "academic", "academic_history", "educational_background"],
    "links": ["links", "social_links", "socialLinks", "urls", "profiles", "online_profiles", "web_presence"],
    "linkedin": ["linkedin", "linkedin_url", "linkedinUrl", "linked_in", "linkedIn", "linkedin_profile"],
    "github": ["github", "github_url", "githubUrl", "git_hub", "github_profile", "gh_url"],
    "portfolio": ["portfolio", "portfolio_url", "portfolioUrl", "website", "personal_website", "personal_site"],
}
EXPERIENCE_ALIASES: dict[str, list[str]] = {
    "company": ["company", "employer", "organization", "company_name", "org"],
    "title": ["title", "role", "position", "job_title", "designation"],
    "start_date": ["start_date", "from", "startDate", "start", "from_date"],
    "end_date": ["end_date", "to", "endDate", "end", "to_date"],
    "description": ["description", "responsibilities", "summary", "details", "about"],
    "location": ["location", "city", "office_location"],
}
EDUCATION_ALIASES: dict[str, list[str]] = {
    "institution": ["institution", "school", "university", "college", "institute", "alma_mater"],
    "degree": ["degree", "qualification", "level", "type"],
    "field_of_study": ["field_of_study", "major", "subject", "discipline", "stream"],
    "start_date": ["start_date", "from", "startDate", "start"],
    "end_date": ["end_date", "to", "endDate", "end", "graduation_date"],
    "gpa": ["gpa", "cgpa", "grade", "score", "percentage"],
}

#: Headings of résumé sections; the first section that has a matching pattern counts.
SECTION_PATTERNS: dict[str, list[str]] = {
    "contact": [r"contact(\s+information)?", r"personal(\s+details)?", r"profile"],
    "summary": [r"summary", r"objective", r"professional\s+summary", r"about(\s+me)?", r"career\s+objective"],
    "skills": [r"(technical\s+)?skills", r"competencies", r"technologies", r"tech(nical)?\s+stack", r"expertise", r"key\s+skills"],
    "experience": [r"(work\s+|professional\s+)?experience", r"employment(\s+history)?", r"work\s+history", r"career\s+history"],
    "education": [r"education(\s+history)?", r"academic(\s+(background|history))?", r"qualifications?"],
    "projects": [r"projects?", r"personal\s+projects?", r"side\s+projects?"],
    "certifications": [r"certifications?", r"certificates?", r"courses?", r"achievements?"],
}
EMAIL_PATTERN = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_PATTERN = r"(?:\+?\d{1,4}[-. \t]?)?\(?\d{2,4}\)?[-. \t]?\d{3,4}[-. \t]?\d{3,4}"
LOCATION_PATTERN = r"(?i)(?:location|address|residing\s+in|based\s+in)[:\-–—=]?\s*([A-Za-z0-9\s,]+)"
CITY_PATTERN = r"(?i)\b(coimbatore|chennai|bangalore|bengaluru|mumbai|delhi|hyderabad|pune|kolkata|san francisco|california|tamil nadu|india)\b"
NOT_A_PLACE = r"(?i)@|http|school|college|university|student|motivated"
DEGREE_PATTERN = r"(?i)(Bachelor|Master|PhD|Doctor|B\.?Tech|M\.?Tech|B\.?Sc|M\.?Sc|MBA|BCA|MCA)"
GPA_LABEL = r"(?i)(?:gpa|cgpa|percentage|percent|marks|grade|score|percentage\s*score)\s*[:\-–—=]?\s*(\d+(?:\.\d+)?)"
GPA_SUFFIX = r"(?i)(\d+(?:\.\d+)?)\s*(?:%|\s*(?:gpa|cgpa|percentage|percent|marks|grade))"
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
PRESENT = ["present", "current", "now", "ongoing", "till date", "till now", "to date", "today", "—", "-", "–"]
#: Corrections of characters that text recognition mistakes in addresses: (pattern, replacement).
EMAIL_FIXES = [(r"(?i)\.ccom$", ".com"), (r"(?i)\.con$", ".com"), (r"(?i)@gma[i1l]{2,}\b", "@gmail")]

#: Usual names of countries. Three-letter codes and other English names: country_table().
COUNTRIES: dict[str, str] = {
    "usa": "US", "u.s.a": "US", "u.s.a.": "US", "united states": "US", "united states of america": "US", "us": "US", "america": "US",
    "uk": "GB", "u.k": "GB", "u.k.": "GB", "great britain": "GB", "england": "GB", "united kingdom": "GB",
    "uae": "AE", "u.a.e": "AE", "u.a.e.": "AE", "united arab emirates": "AE",
    "india": "IN", "china": "CN", "russia": "RU", "south korea": "KR", "korea": "KR", "taiwan": "TW", "hong kong": "HK", "new zealand": "NZ", "south africa": "ZA", "saudi arabia": "SA", "singapore": "SG",
    "germany": "DE", "france": "FR", "italy": "IT", "spain": "ES", "canada": "CA", "australia": "AU", "brazil": "BR", "mexico": "MX", "japan": "JP", "indonesia": "ID", "pakistan": "PK", "bangladesh": "BD",
    "nigeria": "NG", "egypt": "EG", "turkey": "TR", "iran": "IR", "thailand": "TH", "vietnam": "VN", "philippines": "PH", "malaysia": "MY", "netherlands": "NL", "sweden": "SE", "norway": "NO", "denmark": "DK",
    "finland": "FI", "switzerland": "CH", "austria": "AT", "belgium": "BE", "poland": "PL", "ukraine": "UA", "romania": "RO", "czech republic": "CZ", "czechia": "CZ", "hungary": "HU", "portugal": "PT",
    "greece": "GR", "israel": "IL", "colombia": "CO", "argentina": "AR", "chile": "CL", "peru": "PE", "venezuela": "VE", "ecuador": "EC", "kenya": "KE", "ghana": "GH", "ethiopia": "ET", "tanzania": "TZ",
    "uganda": "UG", "morocco": "MA", "algeria": "DZ", "tunisia": "TN", "ireland": "IE", "iceland": "IS", "luxembourg": "LU", "sri lanka": "LK", "nepal": "NP", "iraq": "IQ", "qatar": "QA", "kuwait": "KW",
}
#: Two-letter codes (all officially assigned ones).
ALPHA2 = (
    "AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY CZ DE DJ DK DM DO DZ EC EE EG EH ER ES ET "
    "FI FJ FK FM FO FR GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM IN IO IQ IR IS IT JE JM JO JP KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY "
    "MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW MX MY MZ NA NC NE NF NG NI NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST SV SX SY SZ "
    "TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ UA UG UM US UY UZ VA VC VE VG VI VN VU WF WS YE YT ZA ZM ZW"
)
#: Region: (calling code, digits of a national number, pattern of its start).
PHONE_REGIONS: dict[str, tuple[str, int, int, str]] = {
    "US": ("1", 10, 10, "[2-9][0-9]{2}[2-9]"), "CA": ("1", 10, 10, "[2-9][0-9]{2}[2-9]"), "IN": ("91", 10, 10, "[6-9]"), "GB": ("44", 9, 10, "[1-9]"), "DE": ("49", 7, 11, "[1-9]"), "FR": ("33", 9, 9, "[1-9]"),
    "ES": ("34", 9, 9, "[5-9]"), "IT": ("39", 8, 11, "[03]"), "AU": ("61", 9, 9, "[2-478]"), "SG": ("65", 8, 8, "[3689]"), "JP": ("81", 9, 10, "[1-9]"), "CN": ("86", 11, 11, "1"), "BR": ("55", 10, 11, "[1-9]"), "AE": ("971", 8, 9, "[2-9]"),
}
#: Canonical skills and their other names, lower-case. A larger table can be loaded from a JSON file of that form.
SKILL_ALIASES: dict[str, list[str]] = {
    "JavaScript": ["js", "javascript", "java script", "ecmascript", "es6", "vanilla js"], "TypeScript": ["ts", "typescript", "type script"], "Python": ["py", "python3", "python 3", "python2", "python 2", "python programming", "cpython"],
    "Java": ["java se", "java ee", "java programming", "core java"], "C++": ["cpp", "c plus plus", "cplusplus"], "C#": ["csharp", "c sharp"], "C": ["c programming", "c language"], "Go": ["golang", "go lang"], "R": ["r programming", "r language"],
    "React": ["react.js", "reactjs", "react js"], "Vue.js": ["vue", "vuejs", "vue js", "vue.js"], "Angular": ["angular.js", "angularjs", "angular js"], "Node.js": ["node", "nodejs", "node js"], "Express.js": ["express", "expressjs", "express js"],
    "Django": ["django framework", "drf"], "Flask": ["flask api", "flask framework"], "Spring": ["spring boot", "spring framework"], "Rails": ["ruby on rails", "ror"], "MongoDB": ["mongo", "mongo db"], "PostgreSQL": ["postgres", "postgresql", "pg", "pgsql"],
    "MySQL": ["mysql", "my sql"], "SQLite": ["sqlite", "sqlite3"], "Redis": ["redis cache", "redis db"], "Elasticsearch": ["elastic search", "elastic", "elk"], "SQL": ["structured query language", "sql queries"], "NoSQL": ["no sql"],
    "GraphQL": ["graph ql", "gql"], "REST API": ["rest", "restful", "restful api", "rest apis"], "Docker": ["dockerfile", "docker container", "docker compose"], "Kubernetes": ["k8s", "kube", "kubectl"],
    "AWS": ["amazon web services", "amazon aws", "aws cloud"], "AWS EC2": ["ec2", "amazon ec2", "aws ec2"], "AWS S3": ["s3", "amazon s3", "aws s3"], "GCP": ["google cloud", "google cloud platform"], "Azure": ["microsoft azure", "azure cloud"],
    "CI/CD": ["cicd", "ci cd", "continuous integration", "jenkins", "github actions"], "Git": ["version control", "source control"], "Linux": ["ubuntu", "centos", "debian", "unix"], "Machine Learning": ["ml", "ml models"], "Deep Learning": ["dl", "neural networks"],
    "TensorFlow": ["tensorflow", "tf", "tensor flow"], "PyTorch": ["pytorch", "torch"], "Scikit-learn": ["sklearn", "scikit learn", "scikit-learn"], "NumPy": ["numpy", "np"], "Kafka": ["apache kafka", "kafka streaming"], "Spark": ["apache spark", "pyspark"],
    "Hadoop": ["apache hadoop", "hdfs"], "Airflow": ["apache airflow"], "HTML": ["html5", "html 5"], "CSS": ["css3", "css 3"], "Sass": ["scss"], "OOP": ["object oriented programming"], "Agile": ["agile methodology"], "Scrum": ["scrum master"],
}
# --- End of fixed values ----------------------------------------------------------------------------------------------


_countries: dict[str, str] = {}


def country_table() -> dict[str, str]:
    """Two-letter codes by three-letter code and by English name, lower-case, from the JVM's locale data; empty in a
    session without a JVM gateway, where the tables above count alone."""
    spark = SparkSession.getActiveSession()
    if not _countries and spark is not None and hasattr(spark, "_jvm"):
        locale = spark._jvm.java.util.Locale
        for code in locale.getISOCountries():
            at = locale("", code)
            for name in (at.getISO3Country(), at.getDisplayCountry(locale.ENGLISH)):
                if name:
                    _countries.setdefault(name.lower(), code)
    return _countries


def lookup(source: Column, table: dict[str, float | int | str], default=None) -> Column:
    """A value of a small fixed table, which is one literal in the plan: no join, no shuffle."""
    kind = "string" if any(isinstance(v, str) for v in table.values()) else "int" if all(isinstance(v, int) for v in table.values()) else "double"
    found = F.element_at(F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>"), source.cast("string"))
    return found if default is None else F.coalesce(found, F.lit(default))


def priority(source: Column) -> Column:
    return lookup(source, PRIORITY, 0)


def base_confidence(source: Column) -> Column:
    return lookup(source, BASE_CONFIDENCE, UNKNOWN_CONFIDENCE)


def source_bit(source: Column) -> Column:
    return lookup(source, BIT, 0)


def agreement(mask: Column) -> Column:
    """Confidence of a set of sources given as the sum of their bits."""
    return lookup(mask, AGREEMENT, 0.0)


def sources_of(mask: Column) -> Column:
    """Names of the sources of a set, sorted."""
    return F.array_sort(F.filter(F.array(*[F.when(mask.bitwiseAND(F.lit(b)) > 0, F.lit(s)) for s, b in BIT.items()]), lambda x: x.isNotNull()))
