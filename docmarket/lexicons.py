"""Default word lists and weights. All of them are arguments of the operators.

Larger tables (term patterns, role aliases and families, title-implied terms) come
from the user as DataFrames or dicts of the documented shape.
"""

from __future__ import annotations

# --- fixed values: proof and trust ---------------------------------------------
PROOF_WEIGHTS = {"strong": 1.0, "medium": 0.72, "weak": 0.38, "none": 0.0}
HIGH_PROOF_SECTIONS = ("experience", "projects", "research", "teaching")
SECTION_WEIGHTS = {"experience": 1.0, "projects": 1.0, "research": 0.95, "teaching": 0.9, "summary": 0.45, "certifications": 0.5, "skills": 0.32}
OTHER_SECTION_WEIGHT = 0.4
SECTION_PRIORITY = {"skills": 4, "experience": 3, "projects": 3, "education": 2, "summary": 1}
EVIDENCE_PRIORITY = {"experience": 5, "projects": 5, "skills": 4, "education": 2, "summary": 1, "document": 1}
BASELINE_SOURCE = "role-baseline"
DEMAND_TRUST = {
    "jobicy": 1.0, "remotive": 0.94, "themuse": 0.92, "adzuna": 0.97, "usajobs": 0.88, "remoteok": 0.72, "arbeitnow": 0.62, "role-baseline": 0.58,
}
DEMAND_TRUST_OTHER = 0.84
QUALITY_TRUST = {
    "greenhouse": 1.08, "lever": 1.07, "jooble": 1.04, "jobicy": 1.0, "remotive": 0.94, "themuse": 0.92, "adzuna": 1.02, "usajobs": 0.88,
    "remoteok": 0.72, "arbeitnow": 0.62, "role-baseline": 0.58,
}
QUALITY_TRUST_OTHER = 0.86
GENERIC_SECONDARY_TERMS = ("reporting", "dashboarding", "data visualization", "business intelligence", "excel")
DENSE_FAMILIES = (
    "software engineer", "frontend developer", "full stack developer", "mobile developer", "embedded engineer", "data analyst", "data scientist",
    "machine learning engineer", "data engineer", "database engineer", "devops engineer", "cybersecurity engineer", "qa engineer",
    "solutions architect", "enterprise applications engineer",
)
DENSE_DOMAINS = ("data", "software", "security")
WIDE_GAP_FAMILIES = ("data scientist", "machine learning engineer", "data engineer", "data analyst")
SPARSE_ROLES = ("teacher", "carpenter", "painter")
ABSTRACT_FAMILIES = ("enterprise applications engineer", "engineering leadership", "technical writer")
BUSINESS_DOMAINS = ("marketing", "sales", "customer", "people", "finance", "operations")
FAMILY_GROUPS = {
    "data": ("data analyst", "data scientist", "data engineer", "machine learning engineer", "database engineer"),
    "software": ("software engineer", "frontend developer", "full stack developer", "mobile developer", "embedded engineer", "qa engineer"),
    "infra": ("devops engineer", "support engineer", "solutions architect"),
    "security": ("cybersecurity engineer",),
    "product": ("product manager",),
    "design": ("ui/ux designer",),
    "enterprise": ("enterprise applications engineer",),
    "docs": ("technical writer",),
    "leadership": ("engineering leadership",),
}
DENSE_GROUPS = ("data", "software", "infra", "security")

# --- fixed values: requirement sentences ----------------------------------------
REQUIRED_HINTS = (
    "must have", "required", "requirements", "qualification", "qualifications", "proficient in", "experience with", "hands-on",
    "technical skills", "skills:", "strong knowledge of",
)
PREFERRED_HINTS = ("preferred", "nice to have", "good to have", "bonus", "plus", "desired")
RESPONSIBILITY_HINTS = ("responsibilities", "you will", "in this role", "day in the life", "duties")
SOFT_TERMS = ("communication", "leadership", "problem solving")
LOW_SIGNAL_HINTS = (
    "equal opportunity", "equal employment opportunity", "all qualified applicants", "regard to race", "without regard to",
    "compensation and benefits", "employee benefits", "benefits package", "salary range", "country by country reporting", "transfer pricing",
)
REQUIREMENT_HEADS = (
    "experience with", "experience in", "proficient in", "knowledge of", "knowledge in", "skilled in", "skills:", "requirements:",
    "qualifications:", "must have", "nice to have", "good to have", "bonus:", "tools:", "tech stack:", "stack:", "exposure to",
    "familiarity with", "expertise in",
)
PHRASE_SPLIT = r"(?iU)\s*(?:,|;|\||/|•|·|\band\b|\bor\b)\s*"
LEADING_WORDS = (
    r"(?i)^(?:requirements?|qualifications?|skills?|preferred|must have|nice to have|good to have|bonus|experience with|experience in|proficiency in"
    r"|knowledge of|knowledge in|skilled in|familiarity with|expertise in|tools?|tech stack|stack|exposure to)\s*[:\-]?\s*"
)
NON_TERM_OPENERS = (
    "a ", "an ", "ability to", "advanced", "able to", "all ", "associated", "build ", "building ", "responsible for", "responsibilities include",
    "you will", "we are looking for", "can ", "current", "complete", "demonstrated", "collaborative", "must be", "should be", "strong",
    "excellent", "good", "you excel", "excel in", "passionate", "actively", "written", "as a", "we work",
)
GENERIC_ROLE_TERMS = (
    "analyst", "engineer", "developer", "manager", "teacher", "educator", "instructor", "lecturer", "faculty", "professor", "painter",
    "designer", "specialist", "consultant", "coordinator", "representative", "customer success", "scientist", "administrator", "architect",
    "technician", "lead", "director", "head", "intern",
)
GENERIC_SINGLETONS = (
    "policies", "procedures", "people", "benefits", "operations", "management", "support", "growth", "content", "communication", "english",
)
ALLOWED_SINGLETONS = (
    "siem", "iam", "soc", "etl", "seo", "crm", "erp", "aws", "api", "excel", "tableau", "splunk", "looker", "snowflake", "bigquery", "airflow",
    "dbt", "terraform", "kubernetes", "docker",
)
ALLOWED_COMPONENTS = (
    "access", "cloud", "compute", "computer", "deep", "event", "identity", "incident", "language", "learning", "management", "network",
    "processing", "reliability", "response", "resource", "security", "site", "vision", "vulnerability",
)
ANCHOR_TOKENS = ("sql", "aws", "api", "etl", "seo", "crm", "erp", "siem", "iam", "soc")
BLOCKED_TOKENS = (
    "degree", "discipline", "required", "preferred", "others", "current", "experience", "knowledge", "age", "gender", "religion", "disability",
    "benefits", "salary", "compensation", "state", "origin",
)
FILLER_TOKENS = ("and", "or", "with", "for", "the", "a", "an", "to", "of")
IMPLIED_TERMS = {
    "postgresql": {"sql": 0.72}, "mysql": {"sql": 0.72}, "mongodb": {"sql": 0.28},
    "tableau": {"data visualization": 0.72, "dashboarding": 0.66},
    "power bi": {"excel": 0.24, "data visualization": 0.74, "dashboarding": 0.68},
    "looker": {"data visualization": 0.72, "dashboarding": 0.66}, "dbt": {"sql": 0.72, "data modeling": 0.58}, "airflow": {"etl": 0.66},
    "snowflake": {"sql": 0.64, "data warehousing": 0.72}, "bigquery": {"sql": 0.64, "data warehousing": 0.72},
}

# --- fixed values: places --------------------------------------------------------
GLOBAL_HINTS = ("remote", "worldwide", "global", "anywhere")
COUNTRY = "india"
COUNTRY_HINTS = (
    "india", "indian", "bengaluru", "bangalore", "hyderabad", "pune", "mumbai", "delhi", "gurgaon", "gurugram", "noida", "chennai", "kolkata",
    "ahmedabad",
)
REGION_HINTS = ("apac", "asia", "south asia", "southeast asia")
OTHER_REGION_HINTS = (
    "usa", "u s", "u s a", "united states", "america", "north america", "uk", "united kingdom", "england", "scotland", "ireland", "emea",
    "europe", "european union", "canada", "australia", "new zealand", "netherlands", "germany", "france", "spain", "portugal", "italy",
    "belgium", "sweden", "norway", "denmark", "finland", "poland", "switzerland", "austria", "singapore", "japan", "korea", "south korea",
    "china", "hong kong", "taiwan", "uae", "dubai", "middle east", "latam", "latin america",
)
TITLE_WEAKENERS = ("associate", "coordinator", "representative", "specialist", "support", "manager")

# --- fixed values: role words ----------------------------------------------------
HEAD_TOKENS = (
    "engineer", "developer", "analyst", "scientist", "architect", "designer", "manager", "executive", "representative", "administrator", "admin",
    "writer", "consultant", "specialist", "tester", "researcher", "owner", "support", "recruiter", "accountant", "coordinator", "generalist",
)
SENIORITY_TOKENS = (
    "intern", "junior", "senior", "staff", "principal", "lead", "associate", "entry", "mid", "head", "director", "chief", "cto", "vp",
)
HEAD_VARIANTS = {
    "engineer": ("engineer", "developer"), "developer": ("developer", "engineer"), "analyst": ("analyst", "specialist"),
    "scientist": ("scientist", "engineer", "analyst"), "architect": ("architect", "engineer", "consultant"), "designer": ("designer", "researcher"),
    "manager": ("manager", "owner", "lead"), "executive": ("executive", "representative", "manager"),
    "representative": ("representative", "executive", "specialist"), "administrator": ("administrator", "developer", "engineer"),
    "admin": ("admin", "administrator", "developer"), "writer": ("writer", "documentation engineer"), "consultant": ("consultant", "engineer"),
    "support": ("support engineer", "support specialist"), "recruiter": ("recruiter", "talent acquisition specialist"),
    "accountant": ("accountant", "analyst"), "coordinator": ("coordinator", "specialist"), "generalist": ("generalist", "specialist"),
}
DOMAIN_HEADS = {
    "data": ("analyst", "engineer", "scientist"), "security": ("engineer", "analyst", "architect"), "product": ("manager", "analyst"),
    "design": ("designer", "researcher"), "marketing": ("manager", "specialist", "writer"), "sales": ("executive", "representative", "manager"),
    "customer": ("manager", "specialist", "representative"), "people": ("recruiter", "specialist", "manager", "generalist"),
    "finance": ("analyst", "accountant", "specialist"), "operations": ("manager", "analyst", "coordinator"), "education": ("teacher", "instructor"),
    "trades": ("technician", "contractor"),
}
OTHER_HEADS = ("engineer", "developer")
DOMAIN_TEMPLATES = {
    "software": ("{specialty} engineer", "{specialty} developer", "software engineer"),
    "data": ("{specialty} analyst", "{specialty} engineer", "{specialty} scientist", "data analyst"),
    "security": ("{specialty} engineer", "{specialty} analyst", "security engineer"),
    "product": ("{specialty} manager", "{specialty} analyst", "product manager"),
    "design": ("{specialty} designer", "{specialty} researcher", "ux designer"),
    "education": ("{specialty} teacher", "{specialty} instructor", "teacher"),
    "trades": ("{specialty} technician", "{specialty} contractor"),
    "marketing": ("{specialty} marketing", "{specialty} specialist", "marketing manager"),
    "sales": ("{specialty} executive", "{specialty} representative", "account executive"),
    "customer": ("{specialty} success", "{specialty} support", "customer success manager"),
    "people": ("{specialty} recruiter", "{specialty} specialist", "recruiter"),
    "finance": ("{specialty} analyst", "{specialty} accountant", "financial analyst"),
    "operations": ("{specialty} manager", "{specialty} analyst", "operations manager"),
}
DOMAIN_WORDS = (
    # (domain, points, any of these words, and any of these words)
    ("software", 1.0, ("engineer", "developer", "architect"), ()),
    ("data", 0.8, ("analyst", "scientist"), ()),
    ("data", 1.4, ("data",), ("engineer", "developer", "platform", "pipeline", "warehouse", "etl", "architect")),
    ("data", 1.1, ("ai", "ml", "llm", "prompt", "model", "models", "genai", "generative"), ()),
    ("security", 1.25, ("security", "cyber", "soc", "iam"), ()),
    ("design", 1.25, ("designer", "ux", "ui"), ()),
    ("product", 1.25, ("product", "roadmap", "owner"), ()),
    ("marketing", 1.25, ("marketing", "seo", "sem", "campaign", "brand", "growth", "social"), ()),
    ("sales", 1.25, ("sales", "account", "pipeline", "quota", "sdr", "bdr"), ()),
    ("customer", 1.25, ("customer", "client", "success", "retention", "renewals", "service"), ()),
    ("people", 1.25, ("recruiter", "recruiting", "recruitment", "talent", "hr", "human", "people"), ()),
    ("finance", 1.25, ("finance", "financial", "accountant", "accounting", "bookkeeper", "tax"), ()),
    ("operations", 1.25, ("operations", "ops", "project", "program", "scrum", "delivery", "supply", "logistics"), ()),
    ("education", 1.25, ("teacher", "lecturer", "faculty", "professor"), ()),
    ("trades", 1.25, ("carpenter", "painter", "plumber", "electrician"), ()),
)
# --------------------------------------------------------------------------------
