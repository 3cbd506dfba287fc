"""Word lists, patterns, weights and formats the results depend on.

All patterns keep to the syntax Java regex and RE2 share (no look-around), but for
LONE_UNDERSCORE, which only Java reads.
"""

# --- credentials ---------------------------------------------------------------
SECRET_PATTERNS = [
    r"\bAQ\.[A-Za-z0-9_\-]{20,}\b",
    r"\bAIza[A-Za-z0-9_\-]{35}\b",
    r"\bsk-[A-Za-z0-9]{20,}\b",
]
SECRET_KEY_NAMES = r"(?i)(api[_-]?key|secret|password|passwd|token|credential|auth[_-]?header|bearer)"
REDACTED = "[REDACTED]"
DENIED_TOOLS = ["import_memories", "import_chatgpt_exports"]

# --- window triage ---------------------------------------------------------------
DELIBERATION = (
    r"(?i)\b(why|because|reason|root cause|turns out|the (problem|issue) is|"
    r"trade[- ]?off|pros and cons|vs\.?|versus|instead of|alternative|option|"
    r"consider(ing|ed)?|not sure|unsure|wondering|figure out|working out|"
    r"should i|should we|which (is|one|approach)|better to|"
    r"decid(e|ed|ing)|chose|choosing|opt(ed|ing) for|"
    r"hypothesi|assume|assumption|predict|expect that|"
    r"tried|trying|test(ed|ing)?|experiment|attempt|"
    r"investigat|debug|diagnos|stuck|doesn'?t work|not working|fail(s|ed|ing)?|"
    r"error|exception|traceback|regression|"
    r"approach|strategy|design|plan to|planning|intend|"
    r"turns? out|realized|realised|discovered|found that|learned that)\b"
)
TECHNICAL_SHAPE = (
    r"```|\bTraceback\b|\bException\b|\b0x[0-9a-fA-F]+\b|"
    r"(/[\w.-]+){3,}|\[\d{4}-\d\d-\d\d[ T]\d\d:\d\d|"
    r"\b(def|class|import|SELECT|function|const|async)\b\s"
)
TRIAGE_MIN_EVENTS, TRIAGE_MIN_CHARS, TRIAGE_MIN_SUBSTANTIVE = 3, 40, 3
TOPIC_CUE = (
    r"(?i)(?:^(ok(ay)?|alright|right)[,\s].{0,20}\b(now|next|so|different|another|new)\b)|"
    r"(?:^(now|next|moving on|next up|separately|unrelated|new (topic|question|thing)|different (topic|question|thing))\b)|"
    r"(?:^(let'?s|lets|can we|could we|i want to|i'd like to|switching to|back to|going back to)\b.{0,40}\b(talk about|discuss|move on|switch|look at|focus on|instead)\b)|"
    r"(?:^(changing|change of) (subject|topic)\b)|"
    r"(?:\bon (a|an)(other| different| separate) (note|topic|matter|question)\b)"
)

# --- dates -------------------------------------------------------------------------
MONTH_NAMES = (
    "january|february|march|april|may|june|july|august|september|october|november|december|"
    "jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
)
ISO_DATE = r"\d{4}-\d{1,2}-\d{1,2}(?:[T\s]\d{1,2}:\d{2}:\d{2})?"
MONTH_DAY_YEAR = rf"(?i)(?:{MONTH_NAMES})[.,]?\s+\d{{1,2}}(?:st|nd|rd|th)?[,\s]+\d{{4}}"
DAY_MONTH_YEAR = rf"(?i)\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTH_NAMES})[.,]?\s+\d{{4}}"
MONTH_YEAR = rf"(?i)(?:{MONTH_NAMES})[.,]?\s+\d{{4}}"
MARKED_YEAR = (
    r"(?i)\b(?:in|during|since|as of|around|late|early|mid|q[1-4]|summer|spring|fall|autumn|winter)\s+\d{4}\b|\(\d{4}\)"
)
RELATIVE_TIME = (
    r"(?i)\b(yesterday|recently|last week|last month|last year|a few days ago|earlier today|a while ago|in the past|previously)\b"
)
VALIDITY_BOUNDARY = (
    r"(?i)\b(valid\s+(?:through|until|thru)|expir(?:es|ing|ed|ation)|renews?(?:\s+on)?|"
    r"good\s+(?:through|until)|effective\s+(?:through|until)|active\s+(?:through|until))\b"
)
VALIDITY_LOOKBACK = 30

# --- classification -------------------------------------------------------------------
EPISODIC_VERBS = (
    r"(?i)\b(decided|decides|chose|chooses|selected|opted|agreed|approved|rejected|picked|determined|settled on|"
    r"switched|migrated|updated|upgraded|downgraded|changed|transitioned|replaced|moved|deprecated|renamed|reconfigured|configured|"
    r"released|launched|deployed|published|shipped|completed|finished|achieved|founded|started|initiated|kicked off|closed|graduated|"
    r"resolved|fixed|repaired|debugged|investigated|outage|incident|patched|mitigated|"
    r"met with|discussed with|interviewed|applied to|applied for|submitted|presented to|synced with)\b"
)
EPISODIC_HEADING = (
    r"(?i)(decision|milestone|changelog|change log|history|event|incident|troubleshooting|meeting|timeline|status update|release|submission)"
)
DURABLE_HEADING = (
    r"(?i)(profile|background|biography|bio|about|preference|equipment|hardware|tool|setup|tech stack|skill|reference|overview|concept|architecture)"
)
DURABLE_WORDS = (
    r"(?i)\b(prefers?|likes?|dislikes?|favorite|enjoys?|always wants?|wants? to use|default style|habitually|"
    r"is an?|lives in|based in|works as|works at|employed at|graduated from|native of|born in|speaks fluent|fluent in|"
    r"uses a|has a|owns a|hardware|macbook|laptop|monitor|specs?|inventory|cpu|gpu|ram|"
    r"stack consists of|architecture is|standard practice|always deployed on|coding style|"
    r"described (?:himself|herself|themselves) as \d+|reported being \d+|retirement planning)\b"
)
PREFERENCE_CHANGE = r"(?i)\b(changed|updated|switched)\s+(?:user\s+)?preference"
MAX_EPISODIC_CHARS = 500
BASE_CONFIDENCE = {"episodic": 0.6, "durable_candidate": 0.5, "ambiguous": 0.2, "non_memory": 0.0}
PRECISION_BONUS = {"exact": 0.3, "day": 0.3, "month": 0.15, "year": 0.05, "none": 0.0}

# --- entity-name shapes -----------------------------------------------------------------
FILE_EXTENSION = (
    r"(?i)\.(py|js|ts|json|jsonl|md|html?|parquet|csv|tsv|txt|sh|ya?ml|toml|db|sqlite|safetensors|gif|png|jpe?g|svg|plist|log)$"
)
NUMBER_SHAPE = (
    r"(?i)^[~≈<>]?\d|^(pid|pids|port|index|layer|layers|step|l)[ -]?\d|\b(ip|lan ip)\s+\d|:\d{2,5}$|^[a-z_]\w*=[\w.]+$"
)
LOCAL_LABEL = r"(?i)^(option|phase|part|tab|stage|step|milestone)[ -]?[a-z0-9]{1,3}\b"
CONSTANT_NAME = r"^[A-Z][A-Z0-9]*(_[A-Z0-9]+)+$"
SNAKE_NAME = r"^[a-z0-9]+(_[a-z0-9]+)+$"
CAMEL_NAME = r"^[a-z]{4,}[A-Z]\w*$"
DOTTED_NAME = r"^[a-z_]+(\.[a-z_]+)+(\(\))?$"
CALL_NAME = r"\(\)|\bfunction$"
EXCEPTION_NAME = r"^[A-Z]\w*(Error|Exception)$"
QUOTED_NAME = r"^['\"`].*['\"`]$"
DIMENSION_NAME = r"^\d[DdKk]$"
NUMBERED_NAME = r"^\d[\d,.]*[ -]+[A-Z]"
TRUSTED_TYPES = ["Software", "AIModel"]

# --- retrieval --------------------------------------------------------------------------------
SCAN_STOPWORDS = (
    "a an the this that these those and or but nor of for to in on at by with from into onto over under about "
    "across during is are was were be been being do does did have has had i me my we us our you your it its he "
    "she they them their his her what which who whom whose how why when where whether as if than then else not "
    "no can could will would should may might must just now only very also versus vs"
).split()
BM25_STOPWORDS = (
    "a an and are as at be but by for from has have i if in into is it its me my of on or our so that the their "
    "them then there this to was we were what when which will with you your"
).split()
BM25_TOKEN = r"[a-z0-9][a-z0-9'_-]*"
BM25_K1, BM25_B, BM25_SUBJECT_WEIGHT = 1.4, 0.75, 3
EXCERPT_CHARS, EXCERPT_STRIDE = 280, 40
SNIPPET_WINDOW, SNIPPET_MAX = 280, 3
RRF_K = 60
VECTOR_ARM_K = 6
SCORE_FLOOR_RATIO = 0.4
PROJECT_BOOST_POOL = 24
ALIAS_MARGIN, CENTROID_MARGIN = 0.1, 0.0006

# --- ledger -------------------------------------------------------------------------------------
TIER1_KINDS = ["decision", "plan", "retrospective", "rejected_alternative"]
MERGE_KIND_ORDER = [
    "decision", "plan", "rejected_alternative", "retrospective",
    "finding", "experiment", "hypothesis", "investigation",
]
THREAD_MERGE_CHAR_BUDGET = 3000
CLIENT_SLUGS = [
    (r"local.?agent.?mode", "claude_cowork"),
    (r"claude.*desktop", "claude_desktop"),
    (r"claude.*code", "claude_code"),
    (r"claude.*ai", "claude_desktop"),
    (r"chatgpt|openai", "chatgpt"),
    (r"codex", "codex"),
    (r"cursor", "cursor"),
    (r"antigravity", "antigravity"),
    (r"windsurf", "windsurf"),
    (r"cline", "cline"),
]
UNKNOWN_CLIENT = "unknown_mcp_client"
UNKNOWN_PROJECTS = ["unknown", "other", "tmp-other"]
COMMON_WORD_LABELS = (
    "work personal writing misc archive backup health travel photo audio website vehicle 3d exhibition claude"
).split()

# --- notes -----------------------------------------------------------------------------------------
HEADING = r"^(#{1,5})\s+(.+)$"
BULLET = r"^(\s*)([-*+]|\d+\.)\s+(.+)$"
BULLET_HEADING = r"^(#{1,6})\s+(.+)$"
WIKILINK = r"\[\[([^\]|#]+)"
LEDE_WORDS = 25
TARGET_PREFIX = "WIKI/projects/"

# --- turn evidence features (generic ones) -----------------------------------------------------------
PERSONAL_ACTION = (
    r"(?i)\b(i sustained|i broke|i injured|i retained|i applied|i submitted|i negotiated|i bought|i purchased|i created|i decided|"
    r"i opted for|i chose|let's go with|let's use|i am helping my (boss|manager|director|cto|ceo|team|colleague)|career milestone|"
    r"celebrating (an|my) anniversary|work anniversary|presented an award|received an award|award recognition|draft an email|"
    r"review the following email|draft a message|i am preparing to (create|build|launch|deploy|lead)|formulated a hypothesis|"
    r"presentation objectives|performance optimization)\b"
)
PERSONAL_BIOGRAPHY = (
    r"(?i)\b(i live in|i am \d{1,2} years old|i have a (dog|cat|pet)|my (dog|cat|pet)|i am married|my (wife|husband|spouse|partner)|i work as|"
    r"i am a (software|product|director|architect|engineer|consultant|manager))\b"
)
TURN_FEATURES = {
    "first_person_singular": r"(?i)\b(i|i'm|i've|i'd|i'll|my|myself|me)\b",
    "first_person_org": r"(?i)\b(we|we're|we've|we'd|our|ours|ourselves|us)\b",
    "action_intent": (
        r"(?i)\b(i need to (create|prepare|draft|write|build|develop|organize|propose|present)|"
        r"i want to (create|prepare|draft|write|build|develop|present|propose|share|pitch)|"
        r"i am (creating|preparing|drafting|writing|building|developing|organizing|proposing|presenting)|"
        r"i'm (creating|preparing|drafting|writing|building|developing|organizing|proposing|presenting)|"
        r"help me (develop|draft|create|prepare|write|plan)|i am preparing to (create|build|launch|deploy|lead|present))\b"
    ),
    "completed_action": (
        r"(?i)\b(i (sustained|broke|injured|retained|applied|submitted|negotiated|bought|purchased|created|decided|opted for|chose|"
        r"finalized|presented|received|passed)|received an award|"
        r"presented an award|career milestone|celebrating (an|my) anniversary|work anniversary)\b"
    ),
    "decision": (
        r"(?i)\b(i decided|i opted for|i chose|let's go with|let's use|i settled on|"
        r"i finalized the (title|name|direction|choice) to)\b"
    ),
    "named_artifact": (
        r"(?i)\b(breakout session|session proposal|conference proposal|presentation proposal|proposal for (our|the|a)|"
        r"presentation (on|about|for|to)|talk proposal|abstract for (a|our|the|this)|slides for (our|the|a|my)|"
        r"statement of work|sow|contract|patent application|patent disclosure|self-evaluation|performance review|"
        r"quarterly goals|charter|roadmap|memo)\b"
    ),
    "delivered_portfolio": (
        r"(?i)\b(projects we('ve| have) delivered|what projects we've delivered|what we('ve| have) delivered|research accomplishments|"
        r"in the pipeline (today|currently))\b"
    ),
    "retrospective_event": (
        r"(?i)\b(today|yesterday|last (week|month|year)|on \d{4}-\d{2}-\d{2}|in \d{4}|passed.*(today|yesterday)|meeting today)\b"
    ),
    "hypothetical": (
        r"(?i)\b(imagine you are|suppose you are|what if|hypothetically|let's pretend|in a fictional scenario|roleplay as|so if i am|"
        r"if i am the|if i were|suppose i am|assuming i am)\b"
    ),
    "iterative_refinement": r"(?i)\b(change the title to|shorten it|expand on this|make it more concise|rewrite it|format this as bullets|make this sound professional)\b",
    "generic_drafting": (
        r"(?i)^(write (an?|me an?|a)?\s*(email|letter|memo|speech|abstract|essay)|draft an? email|shorten this|"
        r"make this (shorter|longer|better|concise)|give me a title|format this as bullets|make this sound professional)\b"
    ),
    "pasted_log": r"(?i)(Traceback \(most recent call last\):|\bstdout:|\bstderr:)",
    "third_party_text": (
        r"(?i)\b(is this a scam|is this legitimate|is this phishing)\b|^\s*(hello|dear)\s+[a-z]+[,:]\s+(i am|my name is)\b"
    ),
    "table_request": r"(?i)^(give me a table showing how|show (me )?a table showing how|generate a table showing how)\b",
    "troubleshooting": r"(?i)^(what might be preventing|how do i fix|why is .* not working|what's wrong with)\b",
}
GENERIC_CODE = (
    r"(?i)\b(write|create|convert|translate|debug|fix|explain|optimize|generate|refactor)\b.*\b(function|code|script|class|query|regex|"
    r"algorithm|shader|method|sketch|css|html|sql|c\+\+|python|javascript|rust|arduino|pandas|dataframe)\b"
)
GENERIC_TRIVIA = (
    r"(?i)\b(explain why|what is the history of|who (was|is)|why did|tell me about|how does|what is the difference between|summary of)\b"
)
GENERIC_IMAGE = r"(?i)^(image of|generate an image|draw a|picture of|illustration of)\b"
GENERIC_COMMAND = (
    r"(?i)^(try again|continue|make it (shorter|longer|better|concise)|table format|only provide|summarize|rewrite|yes|no|ok|thanks|thank you|next)\b"
)
GENERIC_DATASET = r"(?i)\b(dataset columns|columns:|show me where i have missing data|do i have the right fields)\b"
GENERIC_COMMAND_WORDS = 6
ROLE_PROFILE = (
    r"(?i)\b(i am (the|a|director|head|vp|manager|architect|engineer|lead|consultant)|my role (as|at|is)|"
    r"i lead (a|the) (research|lab|team|division))\b"
)

# --- review reports -------------------------------------------------------------------------------------
STRONG_KINDS = ["decision", "plan", "rejected_alternative"]
DOC_PRIORITY_CHARS = 1500
CAUSES = [
    ("project_tag", r"\bproject\b.*\b(tag|slug|retag|wrong|missing)|retag|wrong project|project tag|worktree"),
    ("doc_shape", r"frontmatter|front matter|heading|doubled|repeat|duplicated body|body (is )?(twice|repeated)|WIKI/|after related|after sources|malformed|title"),
    ("duplicate", r"duplicate|dup of|same as|already (covered|captured|approved)|superseded by"),
    ("narration", r"narrat|process|investigat|working on|is looking|status update|progress"),
    ("chatter_draft", r"chatter|draft|casual|small talk|throwaway|transient|one-off|ephemeral|boilerplate"),
    ("open_question", r"question|unanswered|no answer|unresolved|waiting|wait for"),
    ("misattribution", r"misattribut|attribut|wrong person|not the user|someone else"),
    ("third_party_or_sensitive", r"third.party|other people|private|financial|legal|medical|salary|sensitive|personal detail"),
    ("churn", r"churn|stale|outdated|changed since|superseded|obsolete"),
]
CORRECTION = (
    r"(?i)\bfor (?:a|my) friend\b|\bnot me\b|\bnot for me\b|\bnot my\b|"
    r"\bfor (?:my )?(?:wife|husband|partner|brother|sister|mom|mother|dad|father|son|daughter|colleague|coworker|client|boss)\b|"
    r"\bon behalf of\b|\bsomeone else\b|\bhe'll\b|\bshe'll\b|\bthey'll\b|"
    r"\bactually,? (?:i|it'?s|this is)\b|\bi meant\b|\bcorrection\b|\bto clarify\b|"
    r"\bnot .{0,15}(?:me|mine|myself)\b|\bsorry,? (?:i|that|meant)\b|\bgift for\b"
)
IDF_VOUCHED, RECURRING_EPISODES = 2.0, 2

# --- full-text hazards ------------------------------------------------------------------------------------
_SEPARATORS = r""",.<>{}\[\]"':;!@#$%^&*()\-+=~?|/\\`"""
LONE_UNDERSCORE = rf"(?<![^\s{_SEPARATORS}])_(?![^\s{_SEPARATORS}])"
LOW_LINE = "＿"
BOILERPLATE_LABELS = [
    "sources", "open questions", "summary", "summary tl dr", "tl dr", "connections", "related works", "related", "questions", "tasks",
    "status", "recommendations", "recommendations next steps", "key findings", "description", "notes", "overview", "next steps",
    "references", "background", "context", "timeline",
]

#: Words that name a kind of thing: alone they are no name, after a name they add little.
GENERIC_NAME_WORDS = ("account", "api", "app", "card", "cli", "client", "code", "desktop", "docs", "library", "page", "project", "server", "service", "tool")
