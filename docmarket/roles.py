"""Role lexicon: families with their aliases, hints, domains, and word rules.

A lexicon is bounded (tens of families, hundreds of phrases). It is compiled into
literal arrays and small local relations. :func:`default_roles` holds a base set;
users extend it with :meth:`RoleLexicon.extend`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
import re

from docmarket import lexicons as X
from docmarket.functions.text import ROLE_GENERIC_TOKENS, ROLE_STOPWORDS

Words = Sequence[str]


def clean(text: str) -> str:
    """As ``functions.text.clean_label``, for lexicon entries."""
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", text)
    return re.sub(r"[^a-z0-9+]+", " ", text.lower()).strip()


def tokens(text: str) -> list[str]:
    return [t for t in clean(text).split() if len(t) > 2 and t not in ROLE_STOPWORDS and t not in ROLE_GENERIC_TOKENS]


@dataclass(frozen=True)
class RoleLexicon:
    domains: Mapping[str, str]  # family -> domain; the families, in order
    synonyms: Mapping[str, str] = field(default_factory=dict)  # alias -> family
    search: Mapping[str, Words] = field(default_factory=dict)
    production: Mapping[str, Words] = field(default_factory=dict)
    keywords: Mapping[str, Words] = field(default_factory=dict)
    title_hints: Mapping[str, Words] = field(default_factory=dict)
    market_hints: Mapping[str, Words] = field(default_factory=dict)
    primary_hints: Mapping[str, Words] = field(default_factory=dict)
    signals: Mapping[str, Words] = field(default_factory=dict)
    adjacent: Mapping[str, Words] = field(default_factory=dict)
    # (groups of words, role): every group must share a word with the label
    rules: Sequence[tuple[tuple[Words, ...], str]] = ()
    boosts: Sequence[tuple[Words, str, float]] = ()
    domain_words: Sequence[tuple[str, float, Words, Words]] = ()
    domain_market: Mapping[str, Words] = field(default_factory=dict)
    domain_primary: Mapping[str, Words] = field(default_factory=dict)
    negative: Mapping[str, Words] = field(default_factory=dict)
    phrase_hints: Sequence[tuple[str, str, Words]] = ()  # (phrase, kind, hints); a one-word phrase matches a word for market and primary
    models: Mapping[str, Words] = field(default_factory=dict)  # family -> ordered terms
    extra_terms: Mapping[str, Words] = field(default_factory=dict)  # family -> recommended after the model
    domain_models: Mapping[str, Words] = field(default_factory=dict)
    domain_extra: Mapping[str, Words] = field(default_factory=dict)
    heads: Words = X.HEAD_TOKENS
    seniority: Words = X.SENIORITY_TOKENS
    head_variants: Mapping[str, Words] = field(default_factory=lambda: X.HEAD_VARIANTS)
    domain_heads: Mapping[str, Words] = field(default_factory=lambda: X.DOMAIN_HEADS)
    templates: Mapping[str, Words] = field(default_factory=lambda: X.DOMAIN_TEMPLATES)
    sparse: Words = X.SPARSE_ROLES

    def extend(self, **tables) -> "RoleLexicon":
        """A lexicon with more entries in the named tables."""
        merged = {}
        for name, extra in tables.items():
            own = getattr(self, name)
            merged[name] = {**own, **extra} if isinstance(own, Mapping) else tuple(own) + tuple(extra)
        return replace(self, **merged)

    @property
    def families(self) -> list[str]:
        return list(self.domains)

    def all_synonyms(self) -> dict[str, str]:
        return {**{f: f for f in self.families}, **{clean(a): f for a, f in self.synonyms.items()}, **dict(self.synonyms)}

    def alias_map(self) -> dict[str, str]:
        """Every cleaned phrase of every family; the first family that lists it wins."""
        out: dict[str, str] = {}
        for fam in self.families:
            own = [fam, *self.search.get(fam, ()), *self.production.get(fam, ()), *self.title_hints.get(fam, ()), *self.keywords.get(fam, ())]
            for phrase in own + [a for a, f in self.synonyms.items() if f == fam]:
                out.setdefault(clean(phrase), fam)
        out.pop("", None)
        return out

    def compact_map(self) -> dict[str, str]:
        """compact key -> the phrase it stands for: a family name, else the shortest phrase."""
        best: dict[str, tuple] = {}
        for phrase in self.alias_map():
            key = phrase.replace(" ", "")
            rank = (0 if phrase in self.domains else 1, len(phrase.split()), len(phrase), phrase)
            best[key] = min(best.get(key, rank), rank)
        return {k: r[-1] for k, r in best.items()}

    def phrases(self, fam: str) -> list[str]:
        own = [fam, *self.search.get(fam, ()), *self.production.get(fam, ()), *self.title_hints.get(fam, ())]
        return sorted({clean(p) for p in own + [a for a, f in self.synonyms.items() if f == fam]} - {""})

    def signal_bank(self, fam: str) -> list[str]:
        bank = set(self.phrases(fam)) | set(self.signals.get(fam, ()))
        for text in [*self.phrases(fam), *self.primary_hints.get(fam, ())]:
            bank.update(tokens(text))
        return sorted(bank - {""})

    def domain_bank(self, domain: str) -> list[str]:
        return sorted({s for f, d in self.domains.items() if d == domain for s in self.signal_bank(f)})

    def domain_order(self) -> list[str]:
        return list(dict.fromkeys([*self.templates, *self.domains.values()]))


def default_roles() -> RoleLexicon:
    """Base families."""
    # --- fixed values -----------------------------------------------------------
    domains = {
        "data analyst": "data", "data scientist": "data", "machine learning engineer": "data", "data engineer": "data", "software engineer": "software",
        "frontend developer": "software", "full stack developer": "software", "devops engineer": "software", "cybersecurity engineer": "security",
        "qa engineer": "software", "product manager": "product", "ui/ux designer": "design", "teacher": "education", "carpenter": "trades", "painter": "trades",
    }
    synonyms = {
        "backend developer": "software engineer", "backend engineer": "software engineer", "fullstack developer": "full stack developer",
        "frontend engineer": "frontend developer", "web developer": "frontend developer", "mern developer": "full stack developer",
        "mern stack developer": "full stack developer", "mern engineer": "full stack developer", "mean stack developer": "full stack developer",
        "python developer": "software engineer", "business analyst": "data analyst", "reporting analyst": "data analyst", "analytics analyst": "data analyst",
        "bi analyst": "data analyst", "ml engineer": "machine learning engineer", "ai engineer": "machine learning engineer",
        "cyber security engineer": "cybersecurity engineer", "security engineer": "cybersecurity engineer",
        "information security engineer": "cybersecurity engineer", "cloud security engineer": "cybersecurity engineer",
        "application security engineer": "cybersecurity engineer", "product security engineer": "cybersecurity engineer",
        "security operations engineer": "cybersecurity engineer", "soc engineer": "cybersecurity engineer", "aws": "devops engineer",
        "amazon web services": "devops engineer", "aws engineer": "devops engineer", "aws devops engineer": "devops engineer",
        "cloud engineer": "devops engineer", "cloud architect": "devops engineer", "cloud infrastructure engineer": "devops engineer",
        "site reliability engineer": "devops engineer", "sre": "devops engineer", "test engineer": "qa engineer", "ui ux designer": "ui/ux designer",
        "ux designer": "ui/ux designer", "ui designer": "ui/ux designer", "educator": "teacher", "instructor": "teacher", "lecturer": "teacher",
        "faculty": "teacher", "professor": "teacher", "assistant professor": "teacher", "associate professor": "teacher", "finish carpenter": "carpenter",
        "rough carpenter": "carpenter", "industrial painter": "painter", "spray painter": "painter",
    }
    search = {
        "data analyst": ("data analyst", "reporting analyst", "business analyst", "bi analyst", "analytics analyst", "insights analyst", "data operations analyst", "product analyst", "operations analyst"),
        "data scientist": ("data scientist", "applied scientist", "ml scientist", "machine learning scientist"),
        "machine learning engineer": ("machine learning engineer", "ml engineer", "ai engineer"),
        "data engineer": ("data engineer", "etl engineer", "analytics engineer"),
        "software engineer": ("software engineer", "backend developer", "python developer", "backend engineer"),
        "frontend developer": ("frontend developer", "frontend engineer", "web developer", "react developer"),
        "full stack developer": ("full stack developer", "fullstack developer", "software engineer"),
        "devops engineer": ("devops engineer", "aws engineer", "site reliability engineer", "cloud engineer", "platform engineer", "cloud architect"),
        "cybersecurity engineer": ("cybersecurity engineer", "security engineer", "cloud security engineer", "application security engineer", "information security engineer", "security operations engineer"),
        "qa engineer": ("qa engineer", "test engineer", "automation tester", "quality assurance engineer"),
        "product manager": ("product manager", "product owner", "associate product manager", "technical product manager", "product lead", "product analyst"),
        "ui/ux designer": ("ui ux designer", "ux designer", "ui designer", "product designer"),
        "teacher": ("teacher", "educator", "instructor", "lecturer", "faculty", "assistant professor", "tutor"),
        "carpenter": ("carpenter", "finish carpenter", "rough carpenter", "construction carpenter"),
        "painter": ("painter", "industrial painter", "spray painter", "coating technician"),
    }
    title_hints = {
        "data analyst": ("data analyst", "reporting analyst", "business intelligence", "business intelligence analyst", "bi analyst", "analytics analyst", "insights analyst", "data operations analyst", "data analytics"),
        "data scientist": ("data scientist", "applied scientist", "machine learning scientist", "ml scientist", "research scientist"),
        "machine learning engineer": ("machine learning engineer", "machine learning", "ml engineer", "ai engineer", "ai ml engineer"),
        "data engineer": ("data engineer", "etl", "analytics engineer"),
        "software engineer": ("software engineer", "software developer", "backend engineer", "backend developer", "application engineer", "python developer"),
        "frontend developer": ("frontend", "front end", "frontend developer", "frontend engineer", "react", "react developer", "ui engineer", "web developer", "web engineer"),
        "full stack developer": ("full stack", "fullstack", "mern", "mern stack", "full stack developer", "full stack engineer", "web developer"),
        "devops engineer": ("devops", "devops engineer", "site reliability", "site reliability engineer", "sre", "platform", "platform engineer", "cloud", "aws", "cloud engineer", "cloud architect", "infrastructure engineer"),
        "cybersecurity engineer": ("application security", "cloud security", "cyber security engineer", "cybersecurity analyst", "cybersecurity engineer", "information security", "penetration tester", "security analyst", "security architect", "security engineer", "security operations", "soc", "soc analyst", "threat intelligence"),
        "qa engineer": ("qa", "qa engineer", "quality assurance", "quality assurance engineer", "test", "test engineer", "automation", "automation test engineer"),
        "product manager": ("product manager", "product owner", "associate product manager", "technical product manager", "product lead", "product analyst", "product"),
        "ui/ux designer": ("designer", "ui", "ux", "product designer"),
        "teacher": ("teacher", "educator", "instructor", "lecturer", "professor", "faculty", "tutor", "assistant professor"),
        "carpenter": ("carpenter", "finish carpenter", "rough carpenter", "cabinet maker", "woodworker"),
        "painter": ("painter", "painting", "coating", "spray", "finisher"),
    }
    market_hints = {
        "data analyst": ("sql", "excel", "power bi", "tableau", "statistics", "data analysis", "pandas", "python", "reporting", "dashboarding", "data visualization", "business intelligence"),
        "data scientist": ("python", "pandas", "numpy", "machine learning", "scikit-learn", "sql", "statistics", "forecasting", "hypothesis testing", "feature engineering", "model deployment", "deep learning", "tensorflow", "pytorch", "nlp", "data visualization", "matplotlib", "seaborn", "spark", "mlops", "azure", "gcp"),
        "machine learning engineer": ("python", "machine learning", "scikit-learn", "tensorflow", "pytorch", "sql", "feature engineering", "model deployment", "mlops", "spark"),
        "data engineer": ("python", "sql", "spark", "hadoop", "etl", "aws", "postgresql"),
        "software engineer": ("python", "java", "javascript", "sql", "docker", "api", "backend"),
        "frontend developer": ("javascript", "typescript", "react", "next.js", "html", "css", "figma"),
        "full stack developer": ("react", "javascript", "typescript", "node.js", "sql", "api"),
        "devops engineer": ("aws", "amazon web services", "docker", "kubernetes", "terraform", "linux", "ci/cd", "ec2", "lambda", "iam", "cloudformation", "monitoring"),
        "cybersecurity engineer": ("network security", "cloud security", "siem", "splunk", "incident response", "iam", "vulnerability management", "soc", "ids/ips", "firewall", "threat hunting", "security operations", "penetration testing", "python", "linux"),
        "qa engineer": ("testing", "pytest", "ci/cd", "javascript", "java", "api"),
        "product manager": ("data analysis", "sql", "communication", "leadership", "excel"),
        "ui/ux designer": ("figma", "ui design", "ux design", "communication"),
        "teacher": ("lesson planning", "classroom management", "curriculum development", "student assessment", "pedagogy", "differentiated instruction", "teaching", "academic instruction"),
        "carpenter": ("woodworking", "framing", "blueprint reading", "finish carpentry", "power tools", "measuring", "safety compliance"),
        "painter": ("painting", "surface preparation", "color matching", "spray painting", "safety compliance", "coating"),
    }
    primary_hints = {
        "data analyst": ("sql", "excel", "pandas", "power bi", "tableau", "statistics", "python", "reporting", "dashboarding"),
        "data scientist": ("python", "pandas", "numpy", "machine learning", "scikit-learn", "sql", "statistics"),
        "machine learning engineer": ("python", "machine learning", "tensorflow", "pytorch", "scikit-learn"),
        "data engineer": ("python", "sql", "spark", "etl", "postgresql", "aws"),
        "software engineer": ("python", "java", "javascript", "api", "docker", "sql"),
        "frontend developer": ("javascript", "typescript", "react", "next.js", "html", "css"),
        "full stack developer": ("javascript", "typescript", "react", "node.js", "sql", "api"),
        "devops engineer": ("aws", "amazon web services", "docker", "kubernetes", "terraform", "linux", "ci/cd", "ec2", "lambda", "iam"),
        "cybersecurity engineer": ("cloud security", "siem", "splunk", "incident response", "iam", "vulnerability management", "soc", "firewall", "threat hunting", "security operations"),
        "qa engineer": ("testing", "pytest", "ci/cd", "javascript", "java", "api"),
        "product manager": ("sql", "excel", "data analysis"),
        "ui/ux designer": ("figma", "ui design", "ux design"),
        "teacher": ("lesson planning", "classroom management", "curriculum development", "student assessment", "differentiated instruction", "teaching"),
        "carpenter": ("woodworking", "framing", "blueprint reading", "finish carpentry", "power tools"),
        "painter": ("painting", "surface preparation", "color matching", "spray painting", "coating"),
    }
    keywords = {
        "data analyst": ("data analyst", "reporting analyst", "analytics analyst", "bi analyst", "business analyst"),
        "data scientist": ("data scientist", "applied scientist", "ml scientist"),
        "machine learning engineer": ("machine learning engineer", "ml engineer", "ai engineer"),
        "data engineer": ("data engineer", "etl engineer", "analytics engineer"),
        "frontend developer": ("frontend", "react developer", "web developer"),
        "software engineer": ("backend", "api developer", "python developer", "software engineer"),
        "full stack developer": ("full stack", "fullstack", "mern", "mern stack", "mean stack"),
        "devops engineer": ("aws", "aws engineer", "devops", "site reliability", "sre", "platform engineer", "cloud engineer", "cloud architect"),
        "cybersecurity engineer": ("cybersecurity", "cyber security", "security engineer", "cloud security", "application security", "information security", "security operations", "soc engineer", "security architect"),
        "qa engineer": ("qa", "quality assurance", "test engineer", "automation tester"),
        "product manager": ("product manager", "product owner", "associate product manager", "technical product manager", "product lead", "product analyst"),
        "ui/ux designer": ("ui ux", "ux designer", "ui designer", "product designer"),
        "teacher": ("teacher", "educator", "instructor", "lecturer", "professor", "assistant professor", "faculty", "tutor"),
        "carpenter": ("carpenter", "finish carpenter", "rough carpenter", "cabinet maker", "woodworker"),
        "painter": ("painter", "painting", "coating", "spray"),
    }
    rules = (
        ((("mern", "mean", "fullstack"),), "full stack developer"), ((("full",), ("stack",)), "full stack developer"),
        ((("react", "next", "nextjs", "vue", "angular", "frontend"),), "frontend developer"),
        ((("cyber", "security", "soc", "siem", "splunk", "iam"),), "cybersecurity engineer"),
        ((("aws", "cloud", "devops", "sre", "terraform", "kubernetes"),), "devops engineer"),
        ((("reporting", "analytics", "bi"),), "data analyst"),
        ((("data",), ("platform", "pipeline", "warehouse", "etl", "architect"), ("engineer", "developer", "architect")), "data engineer"),
        ((("ml", "llm"), ("engineer",)), "machine learning engineer"),
        ((("ai", "llm", "prompt", "genai", "generative"), ("engineer", "developer")), "machine learning engineer"),
        ((("ml", "llm", "scientist"),), "data scientist"),
        ((("node", "nodejs", "golang", "go", "java", "python", "backend", "api"), ("developer", "engineer")), "software engineer"),
    )
    adjacent = {
        "frontend developer": ("full stack developer",), "full stack developer": ("frontend developer", "software engineer"),
        "software engineer": ("full stack developer",), "machine learning engineer": ("data scientist", "data engineer"),
        "data scientist": ("machine learning engineer", "data engineer"), "data engineer": ("data scientist", "machine learning engineer"),
    }
    domain_market = {
        "software": ("api", "sql", "docker"), "data": ("sql", "python", "data analysis", "statistics"),
        "security": ("cloud security", "iam", "siem", "incident response", "splunk"), "product": ("data analysis", "sql", "leadership"),
        "design": ("figma", "ui design", "ux design"), "education": ("lesson planning", "classroom management", "curriculum development"),
        "trades": ("safety compliance",), "marketing": ("digital marketing", "seo", "content marketing", "campaign management", "analytics"),
        "sales": ("sales", "lead generation", "crm", "pipeline management", "account management"),
        "customer": ("customer success", "customer support", "account management", "retention", "crm"),
        "people": ("recruiting", "talent acquisition", "sourcing", "hr operations", "onboarding"),
        "finance": ("financial analysis", "accounting", "excel", "forecasting", "reporting"),
        "operations": ("operations", "process improvement", "project management", "reporting", "vendor management"),
    }
    domain_primary = {
        "software": ("api", "sql"), "data": ("sql", "python"), "security": ("cloud security", "iam", "incident response"), "product": ("data analysis", "sql"),
        "design": ("figma", "ux design"), "education": ("lesson planning", "classroom management"), "trades": ("safety compliance",),
        "marketing": ("digital marketing", "seo", "campaign management"), "sales": ("sales", "crm", "pipeline management"),
        "customer": ("customer success", "customer support", "retention"), "people": ("recruiting", "talent acquisition", "sourcing"),
        "finance": ("financial analysis", "accounting", "excel"), "operations": ("operations", "process improvement", "project management"),
    }
    negative = {
        "data": ("sales", "customer support", "customer service", "travel", "nurse", "billing", "revenue cycle", "onboarding", "talent", "hr", "recruiter"),
        "software": ("sales", "customer support", "customer service", "travel", "billing", "talent", "hr", "recruiter", "account executive"),
        "security": ("sales", "customer support", "customer service", "travel", "billing", "talent", "hr", "recruiter", "onboarding", "armed security", "bouncer", "campus security", "door supervisor", "facility security", "guard", "loss prevention", "patrol", "physical security", "security guard", "surveillance officer", "watchman", "tax", "design verification", "silicon", "rtl", "semiconductor", "chip"),
        "product": ("sales representative", "sales executive", "marketing manager", "travel", "billing", "hr", "recruiter"),
    }
    # ------------------------------------------------------------------------------
    return RoleLexicon(
        domains=domains, synonyms=synonyms, search=search, production=search, keywords=keywords, title_hints=title_hints, market_hints=market_hints,
        primary_hints=primary_hints, adjacent=adjacent, rules=rules, domain_words=X.DOMAIN_WORDS, domain_market=domain_market, domain_primary=domain_primary,
        negative=negative, models=primary_hints, extra_terms=market_hints, domain_models=domain_primary, domain_extra=domain_market,
    )
