"""Fixed values that the results depend on, as plain lists."""

# The fallback stop words.
STOP_WORDS = ["the", "a", "an", "in", "on", "at", "is", "are", "and", "to", "of", "for", "with"]

# What pages that turn away robots say (case doesn't matter).
BOT_PATTERNS = [
    r"captcha\s+verification",
    r"security\s+check\s+failed",
    r"automated\s+access\s+detected",
    r"access\s+denied.*automated",
    r"blocked.*bot",
    r"cloudflare.*ray\s+id",
    r"your\s+IP\s+has\s+been\s+blocked",
]

# Phrases of meaningful pages.
MEANINGFUL_PHRASES = [
    "university", "campus", "college", "academic", "student", "faculty", "staff",
    "course", "class", "program", "degree", "major", "minor", "education",
    "research", "study", "learning",
    "wellness", "health", "counseling", "support", "resource", "service",
    "assistance", "help", "aid", "benefit", "initiative", "thrive", "success",
    "wellbeing", "mental health", "physical health", "emotional health",
    "advising", "tutoring", "mentoring", "center", "office", "department",
    "financial aid", "scholarship", "grant", "funding", "career", "job",
    "internship", "opportunity",
]

# Endings and paths of URLs that aren't fetched.
BLOCKED_EXTENSIONS = "jpg|jpeg|png|gif|pdf|doc|docx|ppt|pptx|zip|rar|exe|css|js|xml|json"
BLOCKED_PATHS = "login|logout|signin|signout|register|profile|cart|checkout"

# Parts of paths by priority.
HIGH_PATHS = ["/about", "/services", "/resources", "/programs"]
MEDIUM_PATHS = ["/wellness", "/health", "/student", "/academic"]
LOW_PATHS = ["/news", "/events", "/contact", "/faq"]
PRIORITY_PATHS = ["/", "/index.html", "/about", "/contact", "/services", "/resources"]
SEED_PATHS = ["/index.html", "/home", "/about", "/contact", "/resources", "/services"]

# Types of topics with the words that tell them, in order.
TOPIC_TYPES = {
    "SERVICE": ["service", "center", "office", "desk", "support"],
    "PROGRAM": ["program", "initiative", "project", "series", "system"],
    "RESOURCE": ["resource", "tool", "material", "guide", "handbook"],
    "WELLNESS": ["wellness", "health", "medical", "counseling", "therapy", "wellbeing"],
    "SUPPORT": ["support", "help", "assistance", "aid", "advising"],
    "LOCATION": ["hall", "building", "center", "campus", "laboratory", "library"],
    "CONTACT": ["contact", "email", "phone", "reach", "connect"],
    "ELIGIBILITY": ["eligible", "qualify", "requirement", "criteria"],
    "ACADEMIC": ["academic", "class", "course", "study", "learning", "education"],
    "FINANCIAL": ["financial", "money", "fund", "payment", "cost", "expense", "scholarship"],
}

# Patterns of entities and their labels, in order.
ENTITY_PATTERNS = [
    (r"\b[A-Z][a-z]+ (University|College|School)\b", "ORG"),
    (r"\b[A-Z][a-z]+ (Center|Service|Office|Department)\b", "ORG"),
    (r"\b[A-Z][a-z]+ (Hall|Building|Library|Center)\b", "FAC"),
    (r"\b(January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}(st|nd|rd|th)?,? \d{4}\b", "DATE"),
    (r"\b\d{1,2}:\d{2} (AM|PM|am|pm)\b", "TIME"),
    (r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", "PERSON"),
]

# Answers that only decline, and endings that only fill.
DISCLAIMERS = [
    r"^I don't have (enough|sufficient) information to answer this question\.?\s*$",
    r"^There is not enough (context|information|data) (provided|available|given) to answer this question\.?\s*$",
    r"^Based on the (provided|given|available) (context|information), I cannot answer this question\.?\s*$",
]
FILLERS = [
    r" I hope (this|that) (helps|answers your question)\.?$",
    r" (Please )?[Ll]et me know if you (have|need) (any|more|further|additional) (questions|information|details)\.?$",
    r" (Feel free to|Please) (ask|contact|reach out)( me)?( if you have| for)? (more|any other|additional) questions\.?$",
]
DECLINED = "I don't have enough information to answer this question."
NO_MODEL = "Answer generation model not available."
NO_ANSWER = "I don't have specific information about this in the available sources."
NOT_COMPLETE = "Based on the available sources, I don't have specific information to answer this question completely."

# Words that questions are asked about when a site gave too few,
# the question, and the questions asked in any case: (text, topic, topic type).
ADAPTIVE_KEYWORDS = [
    "student", "university", "campus", "service", "resource", "support",
    "wellness", "health", "academic", "financial", "career", "housing",
    "registration", "advising", "tutoring", "counseling", "aid", "scholarship",
]
ADAPTIVE_QUESTION = "What information is provided about %s resources or services?"
FALLBACK_QUESTIONS = [
    ("What information is provided on this page?", "General", "GENERAL"),
    ("What services or resources are described here?", "Services", "SERVICE"),
    ("How can students get more information about what's mentioned here?", "Information", "GENERAL"),
]
GENERAL_FALLBACK = ["What services are described on this page?", "How can students access the resources mentioned here?"]

# What a question model is asked, by topic type and by words of the
# content; %s is the topic. The content and the last line follow.
TOPIC_PROMPT = "Based on this content about %s, generate a natural, informative question that a university student might ask:"
TYPE_PROMPTS = {
    "SERVICE": ["Create an informative question exploring what %s is and how it can benefit students:", "Generate a question about accessing or utilizing %s at the university:"],
    "PROGRAM": ["Create an informative question exploring what %s is and how it can benefit students:", "Generate a question about accessing or utilizing %s at the university:"],
    "RESOURCE": ["Create an informative question exploring what %s is and how it can benefit students:", "Generate a question about accessing or utilizing %s at the university:"],
    "LOCATION": ["Generate a question about where to find %s and what services are available there:"],
    "WELLNESS": ["Create a question asking how %s supports student wellbeing or success:"],
    "SUPPORT": ["Create a question asking how %s supports student wellbeing or success:"],
    "FINANCIAL": ["Generate a question about financial aspects of %s that would be relevant to students:"],
}
WORD_PROMPTS = [
    (["eligibility", "requirement", "qualify"], "Create a question about eligibility or requirements for %s:"),
    (["process", "step", "procedure"], "Generate a question about the process or steps involved with %s:"),
]
GENERAL_PROMPTS = [
    "Based on this content, generate a question that would help someone understand the main purpose of this information:",
    "Create a question that would help a student find key resources described in this content:",
    "Generate a question about how students can access the services mentioned in this content:",
    "Create a question about who students should contact for the services described in this content:",
]

# Stages of a run and the header of the CSV output.
STAGES = ("resources_setup", "crawling", "processing", "qa_generation", "evaluation", "output")
CSV_HEADER = "Question,Answer,Source URL,Topic,Topic Type,Overall Score"

# Words of the fixture tables, for queries over them.
FIXTURE_PHRASES = ["the", "tion", "und", "que", "ment", "ing ", "of the", "hen", "der", "los"]
FIXTURE_TYPES = {"SERVICE": ["thing", "ingly"], "PROGRAM": ["ation", "entre"], "LOCATION": ["zut", "heit"], "CONTACT": ["eaux", "ouen"], "ACADEMIC": ["ción", "dos"]}
FIXTURE_KEYWORDS = ["that", "with", "und", "los", "pour", "from", "nicht", "para", "dans", "zutheit"]
