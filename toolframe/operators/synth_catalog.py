"""Fixed values of the synthetic tool-call corpus.

Everything in this module is a fixed value that must equal the reference
for the generated corpus to have the same content and distribution: the tool
catalogue, the value pools, and the weighted templates (phrases, slots,
calls), listed in their natural order. Slot rules are small descriptors
interpreted by ``toolframe.operators.synth``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# The tool catalogue (25 tools), as JSON documents in order.
# --------------------------------------------------------------------------

TOOLS_JSON = [
    '{"name": "get_weather", "description": "Get current weather for a location", "parameters": {"city": {"type": "string", "required": true}, "units": {"type": "string", "enum": ["C", "F"], "required": false, "default": "C"}}}',
    '{"name": "get_stock_price", "description": "Get current stock price for a ticker symbol", "parameters": {"symbol": {"type": "string", "required": true}, "currency": {"type": "string", "required": false, "default": "USD"}}}',
    '{"name": "search_web", "description": "Search the web for information", "parameters": {"query": {"type": "string", "required": true}, "num_results": {"type": "integer", "required": false, "default": 5}}}',
    '{"name": "send_email", "description": "Send an email to a recipient", "parameters": {"to": {"type": "string", "required": true}, "subject": {"type": "string", "required": true}, "body": {"type": "string", "required": true}, "cc": {"type": "string", "required": false}}}',
    '{"name": "create_calendar_event", "description": "Create a new calendar event", "parameters": {"title": {"type": "string", "required": true}, "date": {"type": "string", "required": true}, "time": {"type": "string", "required": true}, "duration_minutes": {"type": "integer", "required": false, "default": 60}, "attendees": {"type": "array", "required": false, "default": []}}}',
    '{"name": "translate_text", "description": "Translate text from one language to another", "parameters": {"text": {"type": "string", "required": true}, "source_lang": {"type": "string", "required": false, "default": "auto"}, "target_lang": {"type": "string", "required": true}}}',
    '{"name": "get_news", "description": "Get latest news articles on a topic", "parameters": {"topic": {"type": "string", "required": true}, "num_articles": {"type": "integer", "required": false, "default": 3}, "language": {"type": "string", "required": false, "default": "en"}}}',
    '{"name": "calculate", "description": "Perform a mathematical calculation", "parameters": {"expression": {"type": "string", "required": true}}}',
    '{"name": "get_restaurant_info", "description": "Get information about a restaurant", "parameters": {"name": {"type": "string", "required": true}, "city": {"type": "string", "required": true}}}',
    '{"name": "book_hotel", "description": "Book a hotel room", "parameters": {"hotel_name": {"type": "string", "required": true}, "check_in": {"type": "string", "required": true}, "check_out": {"type": "string", "required": true}, "guests": {"type": "integer", "required": false, "default": 1}, "room_type": {"type": "string", "required": false, "default": "standard"}}}',
    '{"name": "get_directions", "description": "Get directions between two locations", "parameters": {"origin": {"type": "string", "required": true}, "destination": {"type": "string", "required": true}, "mode": {"type": "string", "enum": ["driving", "walking", "transit"], "required": false, "default": "driving"}}}',
    '{"name": "convert_units", "description": "Convert a value from one unit to another", "parameters": {"value": {"type": "number", "required": true}, "from_unit": {"type": "string", "required": true}, "to_unit": {"type": "string", "required": true}}}',
    '{"name": "get_exchange_rate", "description": "Get the exchange rate between two currencies", "parameters": {"from_currency": {"type": "string", "required": true}, "to_currency": {"type": "string", "required": true}}}',
    '{"name": "set_reminder", "description": "Set a reminder for a specific time", "parameters": {"message": {"type": "string", "required": true}, "datetime": {"type": "string", "required": true}, "repeat": {"type": "string", "enum": ["once", "daily", "weekly"], "required": false, "default": "once"}}}',
    '{"name": "play_music", "description": "Play music by artist, song, or playlist", "parameters": {"query": {"type": "string", "required": true}, "source": {"type": "string", "enum": ["spotify", "youtube", "local"], "required": false, "default": "spotify"}}}',
    '{"name": "get_weather_forecast", "description": "Get a multi-day weather forecast for a location", "parameters": {"city": {"type": "string", "required": true}, "days": {"type": "integer", "required": false, "default": 7}, "units": {"type": "string", "enum": ["C", "F"], "required": false, "default": "C"}}}',
    '{"name": "search_news", "description": "Search and filter news articles by keyword, source, and date range", "parameters": {"keywords": {"type": "string", "required": true}, "source": {"type": "string", "required": false}, "date_from": {"type": "string", "required": false}, "date_to": {"type": "string", "required": false}, "limit": {"type": "integer", "required": false, "default": 10}}}',
    '{"name": "send_sms", "description": "Send an SMS text message to a phone number", "parameters": {"phone_number": {"type": "string", "required": true}, "message": {"type": "string", "required": true}}}',
    '{"name": "book_flight", "description": "Search and book a flight ticket between two cities", "parameters": {"origin": {"type": "string", "required": true}, "destination": {"type": "string", "required": true}, "departure_date": {"type": "string", "required": true}, "return_date": {"type": "string", "required": false}, "passengers": {"type": "integer", "required": false, "default": 1}, "cabin_class": {"type": "string", "enum": ["economy", "business", "first"], "required": false, "default": "economy"}}}',
    '{"name": "get_stock_history", "description": "Get historical price data for a stock ticker over a date range", "parameters": {"symbol": {"type": "string", "required": true}, "start_date": {"type": "string", "required": true}, "end_date": {"type": "string", "required": false}, "interval": {"type": "string", "enum": ["1d", "1wk", "1mo"], "required": false, "default": "1d"}}}',
    '{"name": "add_task", "description": "Add a task or to-do item to a task list (no time-based trigger)", "parameters": {"title": {"type": "string", "required": true}, "due_date": {"type": "string", "required": false}, "priority": {"type": "string", "enum": ["low", "medium", "high"], "required": false, "default": "medium"}, "tags": {"type": "array", "required": false, "default": []}}}',
    '{"name": "convert_currency", "description": "Convert a specific monetary amount from one currency to another", "parameters": {"amount": {"type": "number", "required": true}, "from_currency": {"type": "string", "required": true}, "to_currency": {"type": "string", "required": true}}}',
    '{"name": "get_place_details", "description": "Get detailed information about a place, venue, or point of interest", "parameters": {"place_name": {"type": "string", "required": true}, "city": {"type": "string", "required": false}, "category": {"type": "string", "enum": ["restaurant", "hotel", "attraction", "hospital", "bank", "other"], "required": false, "default": "other"}}}',
    '{"name": "play_podcast", "description": "Play a podcast episode from a specified show", "parameters": {"show_name": {"type": "string", "required": true}, "episode_title": {"type": "string", "required": false}, "playback_speed": {"type": "number", "required": false, "default": 1.0}}}',
    '{"name": "run_code", "description": "Execute a code snippet in a sandboxed environment and return its output", "parameters": {"code": {"type": "string", "required": true}, "language": {"type": "string", "enum": ["python", "javascript", "bash", "sql"], "required": false, "default": "python"}, "timeout_seconds": {"type": "integer", "required": false, "default": 30}}}',
]

# --------------------------------------------------------------------------
# Value pools, in their natural order.
# --------------------------------------------------------------------------

CITIES = [
    "New York", "London", "Tokyo", "Paris", "Sydney", "Toronto", "Berlin",
    "Singapore", "Dubai", "Mumbai", "São Paulo", "Seoul", "Amsterdam", "Chicago",
    "Los Angeles", "Bangkok", "Mexico City", "Cairo", "Istanbul", "Moscow",
    "Shanghai", "Beijing", "Jakarta", "Lagos", "Nairobi", "Cape Town", "Bogotá",
    "Buenos Aires", "Lima", "Karachi", "Manila", "Kuala Lumpur", "Riyadh",
    "Casablanca", "Johannesburg", "Lahore", "Hyderabad", "Chennai", "Kolkata",
    "Bangalore", "Pune", "Ahmedabad", "Vienna", "Zürich", "Brussels",
    "Stockholm", "Oslo", "Helsinki", "Copenhagen", "Warsaw", "Prague",
    "Budapest", "Athens", "Lisbon", "Madrid", "Barcelona", "Milan", "Rome",
    "Frankfurt", "Hamburg", "Munich", "Melbourne", "Brisbane", "Perth",
    "Auckland", "San Francisco", "Seattle", "Boston", "Miami", "Atlanta",
    "Denver", "Phoenix", "Dallas", "Houston", "San Diego", "Portland",
    "Las Vegas", "Minneapolis", "Montreal", "Vancouver", "Calgary",
]

TICKERS = [
    "AAPL", "MSFT", "GOOG", "AMZN", "META", "TSLA", "NVDA", "AMD", "NFLX",
    "UBER", "LYFT", "SPOT", "SHOP", "SQ", "PYPL", "INTC", "ORCL", "IBM",
    "CRM", "ADBE", "QCOM", "AVGO", "TXN", "TSM", "BABA", "JD", "NIO",
    "WMT", "TGT", "COST", "HD", "JPM", "BAC", "C", "WFC", "GS", "MS",
    "V", "MA", "AXP", "DIS", "CMCSA", "T", "VZ", "TMO", "ABT", "JNJ",
    "PFE", "MRNA", "LLY", "MRK", "GILD", "REGN", "AMGN", "COIN", "HOOD",
    "PLTR", "RBLX", "SNAP", "PINS", "ZM", "DOCU", "TWLO", "NET", "DDOG",
]

CURRENCIES = [
    "USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "INR", "BRL",
    "RUB", "KRW", "SGD", "HKD", "NOK", "SEK", "DKK", "MXN", "ZAR", "AED",
    "SAR", "THB", "IDR", "MYR", "PHP", "TWD", "CZK", "PLN", "HUF", "TRY",
]

LANGUAGES = [
    ("es", "Spanish"), ("fr", "French"), ("de", "German"), ("ja", "Japanese"),
    ("zh", "Chinese"), ("ar", "Arabic"), ("pt", "Portuguese"), ("ru", "Russian"),
    ("ko", "Korean"), ("hi", "Hindi"), ("it", "Italian"), ("nl", "Dutch"),
    ("sv", "Swedish"), ("pl", "Polish"), ("tr", "Turkish"), ("vi", "Vietnamese"),
    ("id", "Indonesian"), ("uk", "Ukrainian"), ("ro", "Romanian"), ("el", "Greek"),
]

NEWS_TOPICS = [
    "technology", "finance", "sports", "politics", "science", "health",
    "entertainment", "climate change", "artificial intelligence", "cryptocurrency",
    "space exploration", "renewable energy", "electric vehicles", "cybersecurity",
    "quantum computing", "biotechnology", "geopolitics", "education",
    "real estate", "startups", "gaming", "social media", "e-commerce",
    "autonomous vehicles", "mental health",
]

DATE_PATTERNS = [
    "2026-04-01", "2026-04-05", "2026-04-10", "2026-04-15", "2026-04-20",
    "2026-04-25", "2026-05-01", "2026-05-10", "2026-05-15", "2026-05-20",
    "2026-05-25", "2026-06-01", "2026-06-10", "2026-06-15", "2026-06-20",
    "2026-06-25", "2026-07-01", "2026-07-04", "2026-07-10", "2026-07-15",
    "2026-07-20", "2026-08-01", "2026-08-10", "2026-08-15", "2026-09-01",
    "2026-09-10", "2026-10-01", "2026-10-15", "2026-11-01", "2026-12-01",
    "2026-12-25", "2027-01-01", "2027-01-15", "2027-02-14", "2027-03-01",
]

TIME_PATTERNS = [
    "07:00", "07:30", "08:00", "08:30", "09:00", "09:30", "10:00", "10:30",
    "11:00", "11:30", "12:00", "12:30", "13:00", "13:30", "14:00", "14:30",
    "15:00", "15:30", "16:00", "16:30", "17:00", "17:30", "18:00", "18:30",
    "19:00", "19:30", "20:00", "20:30", "21:00", "21:30", "22:00",
]

PEOPLE = [
    "alice@company.com", "bob@work.org", "carol@firm.io", "dave@startup.co",
    "eve@corp.net", "frank@labs.ai", "grace@tech.com", "henry@uni.edu",
    "irene@research.org", "james@consulting.com", "kate@media.co", "liam@bank.com",
    "mia@hospital.org", "noah@legal.net", "olivia@school.edu", "peter@hotel.com",
    "quinn@press.io", "rose@design.co", "sam@agency.net", "tara@health.org",
]

REMINDER_MESSAGES = [
    "Take medication", "Team standup meeting", "Call mom", "Submit weekly report",
    "Pay rent", "Gym session", "Doctor appointment", "Project deadline",
    "Pick up kids from school", "Car service appointment", "Dentist visit",
    "Grocery shopping", "Flight check-in", "Hotel checkout", "Pay credit card bill",
    "Renew subscription", "Birthday dinner reservation", "Conference call",
    "Code review session", "Performance review", "Training session",
    "Submit expense report", "Quarterly board meeting", "Product demo",
    "Client presentation", "System backup", "Tax filing deadline",
    "Passport renewal", "Insurance payment", "Annual health check-up",
]

PHRASES_TO_TRANSLATE = [
    "Hello, how are you today?", "The weather is beautiful outside.",
    "Can you help me find a good restaurant?", "I need directions to the airport.",
    "What time does the meeting start?", "Thank you very much for your help.",
    "I would like to book a table for two.", "Where is the nearest pharmacy?",
    "How much does this cost?", "Could you please speak more slowly?",
    "I don't understand. Can you repeat that?", "Is there a doctor available?",
    "I have lost my passport.", "What is the WiFi password?",
    "I am allergic to nuts.", "Please call me a taxi.",
    "The bill, please.", "Do you accept credit cards?",
    "I need to cancel my reservation.", "When does the next train leave?",
    "How long is the flight?", "I am looking for a vegetarian option.",
    "Can I have a wake-up call at 7am?", "Where is the nearest ATM?",
    "I would like to check out.",
]

MUSIC_QUERIES = [
    "Bohemian Rhapsody by Queen", "Blinding Lights by The Weeknd",
    "Jazz classics playlist", "Lo-fi hip hop beats", "Classical piano Chopin",
    "Taylor Swift greatest hits", "Top 50 Global Spotify", "90s rock anthems",
    "Morning workout playlist", "Relaxing ambient music", "Ed Sheeran Shape of You",
    "Billie Eilish discography", "Daft Punk Random Access Memories",
    "Focus mode deep work playlist", "Dinner party jazz", "Hip hop 2025 hits",
    "Adele Someone Like You", "Coldplay Yellow", "Dance party playlist",
    "Metallica Nothing Else Matters", "Classical music for studying",
]

SEARCH_QUERIES = [
    "best Italian restaurants near me", "how to fix a leaking faucet",
    "Python asyncio tutorial 2026", "best hiking trails in Colorado",
    "home remedies for a cold", "how to invest in index funds",
    "machine learning interview questions", "easiest programming language to learn",
    "electric car charging stations near me", "best noise cancelling headphones 2026",
    "how to meditate for beginners", "vegan protein recipes",
    "remote work productivity tips", "how to negotiate a salary",
    "real estate investment basics", "cloud computing certifications",
    "data science career path", "sustainable living tips",
    "how to start a podcast", "best budget travel destinations 2026",
    "learn Spanish in 30 days", "home gym equipment recommendations",
    "dividend investing strategy", "how to write a cover letter",
    "best project management tools",
]

# (from_unit, to_unit, low, high, decimals): value = round(uniform(low, high), decimals)
UNIT_CONVERSIONS = [
    ("km", "miles", 1, 1000, 1), ("miles", "km", 1, 600, 1), ("kg", "lbs", 0.5, 200, 1),
    ("lbs", "kg", 1, 440, 1), ("celsius", "fahrenheit", -20, 45, 1), ("fahrenheit", "celsius", -4, 113, 1),
    ("meters", "feet", 1, 1000, 1), ("feet", "meters", 1, 3000, 1), ("liters", "gallons", 0.5, 100, 1),
    ("gallons", "liters", 0.1, 26, 1), ("inches", "cm", 1, 72, 1), ("cm", "inches", 1, 200, 1),
    ("oz", "grams", 0.5, 64, 1), ("grams", "oz", 1, 1814, 0), ("MB", "GB", 100, 100000, 0),
    ("mph", "kph", 5, 200, 1), ("kph", "mph", 8, 320, 1), ("acres", "hectares", 0.5, 500, 1),
    ("hectares", "acres", 0.2, 200, 1), ("calories", "kilojoules", 100, 3000, 0),
]

# (expression, instruction) with integer slots a, b, c
MATH_TEMPLATES = [
    ("{a} + {b}", "What is {a} plus {b}?"),
    ("{a} - {b}", "What is {a} minus {b}?"),
    ("{a} * {b}", "What is {a} multiplied by {b}?"),
    ("{a} / {b}", "What is {a} divided by {b}?"),
    ("{a} ** 2", "What is {a} squared?"),
    ("({a} + {b}) * {c}", "Calculate ({a} + {b}) times {c}."),
    ("{a} % {b}", "What is {a} modulo {b}?"),
    ("{a} * {b} + {c}", "What is {a} times {b} plus {c}?"),
    ("round({a} / {b}, 2)", "Divide {a} by {b} and round to 2 decimal places."),
    ("{a} ** 3", "What is {a} cubed?"),
]

EMAIL_SUBJECTS = [
    "Meeting tomorrow", "Project update", "Quick question", "Report attached",
    "Follow-up from our call", "Invitation", "Action required", "FYI",
    "Weekly summary", "Urgent: please review", "Re: your request",
    "New proposal", "Budget review", "Team offsite planning", "Job offer",
]

EMAIL_BODIES = [
    "Hi, please see the attached report.",
    "Hi, just following up on our earlier conversation.",
    "Hello, do you have a moment to discuss this?",
    "Please find the requested information below.",
    "Quick update: everything is on track.",
    "I wanted to share a few thoughts on this topic.",
    "Could you review this at your earliest convenience?",
    "Kindly confirm receipt of this email.",
]

HOTEL_TYPES = ["standard", "deluxe", "suite", "penthouse", "executive", "economy"]

PHONE_NUMBERS = [
    "+1-555-0100", "+1-555-0142", "+1-555-0187", "+1-555-0199",
    "+44-20-7946-0958", "+44-20-7946-1234", "+49-30-12345678",
    "+81-3-1234-5678", "+33-1-23-45-67-89", "+61-2-9876-5432",
    "+91-98765-43210", "+86-10-1234-5678", "+55-11-98765-4321",
    "+7-495-123-4567", "+82-2-1234-5678", "+971-4-123-4567",
]

PODCAST_SHOWS = [
    "The Tim Ferriss Show", "Lex Fridman Podcast", "How I Built This",
    "Masters of Scale", "The Daily", "Planet Money", "Radiolab",
    "Serial", "SmartLess", "Conan O'Brien Needs a Friend",
    "Crime Junkie", "Stuff You Should Know", "The Joe Rogan Experience",
    "Hardcore History", "99% Invisible", "Hidden Brain",
    "Freakonomics Radio", "TED Talks Daily", "The Knowledge Project",
    "Acquired", "All-In Podcast", "Darknet Diaries",
    "Software Engineering Daily", "Programming Throwdown",
]

SMS_MESSAGES = [
    "I'm running 10 minutes late.", "Can we reschedule?", "On my way!",
    "Call me when you get a chance.", "Did you get my email?",
    "The meeting starts in 30 minutes.", "I'll be there by 5pm.",
    "Can you send me the address?", "Package delivered!", "Don't forget: 3pm today.",
]

TASKS = [
    "Write project proposal", "Review pull requests", "Update documentation",
    "Call insurance company", "Fix login bug", "Prepare presentation slides",
    "Pay utility bills", "Schedule dentist appointment", "Clean up database",
    "Reply to client emails", "Refactor authentication module", "Buy groceries",
    "Submit expense report", "Read chapter 5", "Back up laptop",
]

PLACES = [
    "Eiffel Tower", "Louvre Museum", "Big Ben", "Colosseum", "Sagrada Familia",
    "Central Park", "Times Square", "Buckingham Palace",
    "Statue of Liberty", "Golden Gate Bridge", "Lincoln Memorial",
    "Sydney Opera House", "Burj Khalifa", "Taj Mahal", "Machu Picchu",
]

CODE_SNIPPETS = [
    ("python", "print([x**2 for x in range(1, 11)])"),
    ("python", "import hashlib; print(hashlib.md5(b'hello').hexdigest())"),
    ("python", "from datetime import datetime; print(datetime.now().isoformat())"),
    ("javascript", "console.log(Array.from({length: 5}, (_, i) => i * 2))"),
    ("javascript", "const s = 'hello world'; console.log(s.split(' ').reverse().join(' '))"),
    ("bash", "echo $(date) && ls -la"),
    ("sql", "SELECT name, email FROM users WHERE active = 1 LIMIT 10"),
    ("python", "data = {'a': 1, 'b': 2}; print(sum(data.values()))"),
    ("python", "import math; print([math.sqrt(x) for x in [4, 9, 16, 25]])"),
    ("sql", "SELECT COUNT(*) as total, status FROM orders GROUP BY status"),
]

AMBIGUOUS_SMS = ["I'm on my way.", "Running late!", "Call me back.", "See you soon.", "Just landed.",
                 "At the entrance."]
AMBIGUOUS_TASKS = ["Call the bank", "Return library books", "Fix that bug", "Write unit tests", "Update resume",
                   "Review budget"]
AMBIGUOUS_CODE = [
    ("python", "import statistics; print(statistics.mean([10, 20, 30, 40]))"),
    ("python", "print(sorted({'a': 3, 'b': 1, 'c': 2}.items(), key=lambda x: x[1]))"),
    ("javascript", "console.log([1,2,3,4,5].reduce((a,b) => a+b, 0))"),
]
MEETING_TITLES = ["Team sync", "Project review", "Client call", "Quarterly planning", "Design sprint",
                  "1:1 with manager", "Product demo", "Sprint retrospective"]
EVENT_TITLES = ["Team Building Day", "Product Launch", "Annual Summit", "Hackathon", "Strategy Workshop"]
WEATHER_REMINDERS = ["Check weather before departure", "Pack an umbrella", "Wear a coat", "Bring sunscreen",
                     "Prepare for rain"]

POOLS = {
    "cities": CITIES, "tickers": TICKERS, "currencies": CURRENCIES, "languages": LANGUAGES,
    "topics": NEWS_TOPICS, "dates": DATE_PATTERNS, "times": TIME_PATTERNS, "people": PEOPLE,
    "reminders": REMINDER_MESSAGES, "phrases": PHRASES_TO_TRANSLATE, "music": MUSIC_QUERIES,
    "searches": SEARCH_QUERIES, "units": UNIT_CONVERSIONS, "math": MATH_TEMPLATES, "subjects": EMAIL_SUBJECTS,
    "bodies": EMAIL_BODIES, "hotel_types": HOTEL_TYPES, "phones": PHONE_NUMBERS, "podcasts": PODCAST_SHOWS,
    "sms": SMS_MESSAGES, "tasks": TASKS, "places": PLACES, "snippets": CODE_SNIPPETS,
    "amb_sms": AMBIGUOUS_SMS, "amb_tasks": AMBIGUOUS_TASKS, "amb_code": AMBIGUOUS_CODE,
    "meetings": MEETING_TITLES, "events": EVENT_TITLES, "weather_reminders": WEATHER_REMINDERS,
}
# Field names of tuple pools.
POOL_FIELDS = {"languages": ("code", "name"), "units": ("from", "to", "lo", "hi", "digits"),
               "math": ("expr", "instr"), "snippets": ("lang", "code"), "amb_code": ("lang", "code")}


# --------------------------------------------------------------------------
# Slot rules (interpreted by synth.py)
# --------------------------------------------------------------------------

@dataclass(frozen=True)
class Pool:
    """Uniform draw from ``POOLS[name][lo:hi]`` (G8 slices)."""
    name: str
    lo: int = 0
    hi: int | None = None


@dataclass(frozen=True)
class Pair:
    """Two distinct draws from a pool slice (G4); fields ``first`` and ``second``."""
    name: str
    lo: int = 0
    hi: int | None = None


@dataclass(frozen=True)
class Other:
    """Draw from a pool slice excluding another slot's value or a constant."""
    name: str
    exclude: str
    lo: int = 0
    hi: int | None = None
    exclude_is_const: bool = False


@dataclass(frozen=True)
class Choice:
    """Uniform choice among literal values; repeats weight (G6); None = omitted."""
    values: tuple


@dataclass(frozen=True)
class Int:
    """Uniform integer in [lo, hi]."""
    lo: int
    hi: int


@dataclass(frozen=True)
class Rounded:
    """round(uniform(lo, hi), digits) using the bounds of a unit-conversion slot."""
    conv: str


@dataclass(frozen=True)
class Coin:
    """The value of ``slot`` when a uniform draw exceeds ``p``, else None."""
    slot: str
    p: float


@dataclass(frozen=True)
class NullIf:
    """The value of ``slot`` unless it equals ``value`` (then None)."""
    slot: str
    value: object


@dataclass(frozen=True)
class Map:
    """Derived text: ``mapping[slot value]``."""
    slot: str
    mapping: tuple


@dataclass(frozen=True)
class Fmt:
    """Derived text from a template; empty when a referenced slot is None and ``optional``."""
    template: str
    optional: bool = False


@dataclass(frozen=True)
class FmtChoice:
    """Uniform choice among formatted templates."""
    templates: tuple


@dataclass(frozen=True)
class FmtPool:
    """A row of a template pool (``math``) formatted with other slots; fields by name."""
    name: str


@dataclass(frozen=True)
class ListOf:
    """A one-element list of a slot's value."""
    slot: str


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Template:
    name: str
    weight: int
    category: str
    slots: dict = field(default_factory=dict)
    phrases: tuple = ()
    calls: tuple = ()          # ((tool, ((arg, value_spec), ...)), ...)


C_OR_F = Choice(("C", "F"))
UNIT_WORD = Map("units", (("C", "Celsius"), ("F", "Fahrenheit")))

# --------------------------------------------------------------------------
# The 45 weighted templates, in the reference's order.
# Value specs in calls: "{slot}" keeps the slot's type; other strings are
# formatted text; anything else is a literal.
# --------------------------------------------------------------------------

SINGLE = [
    Template("weather", 4, "weather", {"city": Pool("cities"), "units": C_OR_F, "unit_word": UNIT_WORD}, (
        "What is the weather like in {city}?", "Check the current weather in {city} in {unit_word}.",
        "Is it raining in {city} right now?", "Tell me the temperature in {city}.",
        "What should I wear in {city} today?", "How hot or cold is it in {city}?",
        "Get me the current weather for {city} in {unit_word}.", "What's the weather forecast for {city}?",
        "Do I need an umbrella in {city} today?"),
        (("get_weather", (("city", "{city}"), ("units", "{units}"))),)),
    Template("stock", 3, "finance", {"ticker": Pool("tickers"), "currency": Choice(("USD", "EUR", "GBP")),
                                     "opt_currency": Coin("currency", 0.5)}, (
        "What is the current price of {ticker}?", "How much is {ticker} trading at today?",
        "Get me the stock price for {ticker}.", "Check the latest price for {ticker} shares.",
        "What's {ticker} at right now?", "Fetch the current {ticker} stock value in {currency}.",
        "Is {ticker} up or down today?", "How is {ticker} performing in the market?"),
        (("get_stock_price", (("symbol", "{ticker}"), ("currency", "{opt_currency}"))),)),
    Template("translate", 3, "translation", {"lang": Pool("languages"), "text": Pool("phrases")}, (
        "Translate '{text}' to {lang.name}.", "How do you say '{text}' in {lang.name}?",
        "Convert this to {lang.name}: {text}", "What is the {lang.name} translation of: {text}",
        "I need '{text}' in {lang.name}.", "Please translate the following to {lang.name}: {text}"),
        (("translate_text", (("text", "{text}"), ("target_lang", "{lang.code}"))),)),
    Template("calculate", 4, "math", {"a": Int(2, 9999), "b": Int(2, 999), "c": Int(2, 99),
                                      "math": FmtPool("math")}, (
        "{math.instr}",),
        (("calculate", (("expression", "{math.expr}"),)),)),
    Template("convert_units", 3, "conversion", {"conv": Pool("units"), "value": Rounded("conv")}, (
        "Convert {value} {conv.from} to {conv.to}.", "How many {conv.to} is {value} {conv.from}?",
        "What is {value} {conv.from} in {conv.to}?", "I need to convert {value} {conv.from} into {conv.to}.",
        "Express {value} {conv.from} as {conv.to}."),
        (("convert_units", (("value", "{value}"), ("from_unit", "{conv.from}"), ("to_unit", "{conv.to}"))),)),
    Template("reminder", 3, "productivity", {"msg": Pool("reminders"), "date": Pool("dates"), "time": Pool("times"),
                                             "repeat": Choice(("once", "daily", "weekly", None, None))}, (
        "Set a reminder to '{msg}' on {date} at {time}.", "Remind me to {msg|lower} at {time} on {date}.",
        "Create a reminder for '{msg}' — {date} {time}.",
        "I need a reminder about '{msg}' scheduled for {date} at {time}.",
        "Add '{msg}' to my reminders for {date}, {time}."),
        (("set_reminder", (("message", "{msg}"), ("datetime", "{date}T{time}:00"), ("repeat", "{repeat}"))),)),
    Template("exchange_rate", 2, "finance", {"cur": Pair("currencies"),
                                             "amount": Choice((1, 50, 100, 500, 1000, 5000, 10000))}, (
        "What is the exchange rate from {cur.first} to {cur.second}?", "How much is {amount} {cur.first} in {cur.second}?",
        "Get the {cur.first}/{cur.second} exchange rate.", "Convert {amount} {cur.first} to {cur.second}.",
        "What's the current {cur.first} to {cur.second} rate?",
        "I need the exchange rate between {cur.first} and {cur.second}."),
        (("get_exchange_rate", (("from_currency", "{cur.first}"), ("to_currency", "{cur.second}"))),)),
    Template("news", 3, "news", {"topic": Pool("topics"), "n": Choice((3, 5, 7, 10))}, (
        "Get me the latest news about {topic}.", "What are the top {n} news stories on {topic}?",
        "Show me recent headlines about {topic}.", "Find the latest {n} articles on {topic}.",
        "What's happening in {topic} right now?", "Give me a news update on {topic}."),
        (("get_news", (("topic", "{topic}"), ("num_articles", "{n}"))),)),
    Template("search", 3, "search", {"query": Pool("searches"), "n": Choice((3, 5, 8, 10))}, (
        "Search the web for: {query}", "Find information about {query}.", "Look up '{query}' online.",
        "I need {n} search results for: {query}", "Google: {query}", "Can you search for {query}?"),
        (("search_web", (("query", "{query}"), ("num_results", "{n}"))),)),
    Template("music", 2, "entertainment", {"query": Pool("music"),
                                           "source": Choice(("spotify", "youtube", "local", None))}, (
        "Play {query}.", "I want to listen to {query}.", "Put on {query}.", "Start playing {query}.",
        "Queue up {query}.", "Play some {query} for me."),
        (("play_music", (("query", "{query}"), ("source", "{source}"))),)),
    Template("directions", 3, "navigation", {"od": Pair("cities"),
                                             "mode": Choice(("driving", "walking", "transit", "driving"))}, (
        "How do I get from {od.first} to {od.second}?", "Give me directions from {od.first} to {od.second}.",
        "Navigate from {od.first} to {od.second} by {mode}.", "What's the best route from {od.first} to {od.second}?",
        "I need {mode} directions from {od.first} to {od.second}.", "Get me from {od.first} to {od.second}."),
        (("get_directions", (("origin", "{od.first}"), ("destination", "{od.second}"), ("mode", "{mode}"))),)),
    Template("send_email", 3, "communication", {"to": Pool("people"), "subject": Pool("subjects"),
                                                "body": Pool("bodies")}, (
        "Send an email to {to} with subject '{subject}'.", "Email {to}: {subject}",
        "Write an email to {to} about {subject}.", "Compose and send an email to {to} — Subject: {subject}.",
        "Send {to} an email titled '{subject}'."),
        (("send_email", (("to", "{to}"), ("subject", "{subject}"), ("body", "{body}"))),)),
    Template("weather_forecast", 3, "weather", {"city": Pool("cities"), "days": Choice((3, 5, 7, 10, 14)),
                                                "units": C_OR_F, "unit_word": UNIT_WORD}, (
        "What will the weather be like in {city} over the next {days} days?",
        "Give me a {days}-day weather forecast for {city} in {unit_word}.",
        "What's the extended forecast for {city} this week?", "Will it rain in {city} in the coming days?",
        "Show me the upcoming weather outlook for {city} for the next {days} days.",
        "What should I pack for a trip to {city} over the next {days} days?",
        "I'm travelling to {city} next week — what's the weather forecast?"),
        (("get_weather_forecast", (("city", "{city}"), ("days", "{days}"), ("units", "{units}"))),)),
    Template("search_news", 3, "news", {
        "topic": Pool("topics"),
        "kw": FmtChoice(("{topic} policy", "new {topic} research", "{topic} breakthrough", "latest {topic} updates",
                         "{topic} controversy", "{topic} regulation")),
        "source": Choice((None, "BBC", "Reuters", "TechCrunch", "Bloomberg", "CNBC", None)),
        "limit": Choice((5, 10, 15, 20)), "date_from": Choice((None, "2026-03-01", "2026-01-01", None)),
        "from_source": Fmt(" from {source}", optional=True)}, (
        "Search for news articles about '{kw}'.", "Find news pieces matching the keyword '{kw}'.",
        "Look up recent news about '{kw}' — show me {limit} results.",
        "I want news articles that specifically mention '{kw}'.", "Search news for '{kw}'{from_source}."),
        (("search_news", (("keywords", "{kw}"), ("limit", "{limit}"), ("source", "{source}"),
                          ("date_from", "{date_from}"))),)),
    Template("send_sms", 3, "communication", {"phone": Pool("phones"), "msg": Pool("sms")}, (
        "Text {phone}: {msg}", "Send a text message to {phone} saying '{msg}'.",
        "SMS {phone} with the message: {msg}", "Send '{msg}' via SMS to {phone}.",
        "Drop a quick text to {phone}: {msg}"),
        (("send_sms", (("phone_number", "{phone}"), ("message", "{msg}"))),)),
    Template("book_flight", 3, "travel", {
        "od": Pair("cities"), "dep": Pool("dates", 0, 15), "ret_pick": Pool("dates", 15, 30),
        "ret": Coin("ret_pick", 0.4), "passengers": Choice((1, 1, 2, 3)),
        "cabin": Choice(("economy", "economy", "business", "first")), "cabin_arg": NullIf("cabin", "economy")}, (
        "Book a flight from {od.first} to {od.second} departing {dep}.",
        "I need a {cabin} class flight from {od.first} to {od.second} on {dep}.",
        "Find and book me a flight: {od.first} → {od.second}, {dep}, {passengers} passenger(s).",
        "Reserve a flight ticket from {od.first} to {od.second} on {dep}.",
        "Book {passengers} seat(s) on a flight from {od.first} to {od.second} leaving {dep}."),
        (("book_flight", (("origin", "{od.first}"), ("destination", "{od.second}"), ("departure_date", "{dep}"),
                          ("passengers", "{passengers}"), ("return_date", "{ret}"), ("cabin_class", "{cabin_arg}"))),)),
    Template("stock_history", 3, "finance", {
        "ticker": Pool("tickers"), "start": Pool("dates", 0, 10), "end": Pool("dates", 15, 25),
        "interval": Choice(("1d", "1wk", "1mo")),
        "interval_word": Map("interval", (("1d", "daily"), ("1wk", "weekly"), ("1mo", "monthly")))}, (
        "Show me the historical price chart for {ticker} from {start} to {end}.",
        "What were {ticker}'s prices between {start} and {end}?",
        "Get {interval_word} historical data for {ticker} since {start}.",
        "How did {ticker} perform from {start} to {end}?",
        "Pull {ticker} price history from {start} with {interval_word} intervals.",
        "I want to see {ticker}'s trading history between {start} and {end}."),
        (("get_stock_history", (("symbol", "{ticker}"), ("start_date", "{start}"), ("end_date", "{end}"),
                                ("interval", "{interval}"))),)),
    Template("add_task", 3, "productivity", {
        "title": Pool("tasks"), "priority": Choice(("low", "medium", "high")),
        # the empty tag list is never sent (truthiness), so it is drawn as None
        "tags": Choice((None, ("work",), ("personal",), ("urgent",), ("work", "review"))),
        "due_pick": Pool("dates", 0, 10), "due": Coin("due_pick", 0.5)}, (
        "Add '{title}' to my to-do list.", "Create a task: {title}.",
        "Put '{title}' on my task list with {priority} priority.", "I need to do: {title}. Add it as a task.",
        "Add a {priority}-priority task: {title}.", "Log a new task — '{title}'."),
        (("add_task", (("title", "{title}"), ("priority", "{priority}"), ("tags", "{tags}"), ("due_date", "{due}"))),)),
    Template("convert_currency", 3, "finance", {"cur": Pair("currencies", 0, 15),
                                                "amount": Choice((50, 100, 200, 500, 1000, 2500, 5000, 10000))}, (
        "Convert {amount} {cur.first} to {cur.second}.", "How much is {amount} {cur.first} in {cur.second}?",
        "I have {amount} {cur.first} — convert it to {cur.second}.", "What's {amount} {cur.first} worth in {cur.second}?",
        "Change {amount} {cur.first} into {cur.second} for me.", "I need to convert {amount} {cur.first} to {cur.second}."),
        (("convert_currency", (("amount", "{amount}"), ("from_currency", "{cur.first}"),
                               ("to_currency", "{cur.second}"))),)),
    Template("place_details", 2, "information", {
        "place": Pool("places"), "city_pick": Pool("cities"), "city": Coin("city_pick", 0.5),
        "category": Choice(("attraction", "restaurant", "hotel", "hospital", "other")),
        "category_arg": NullIf("category", "other")}, (
        "Get information about {place}.", "Tell me about {place} in {city_pick}.",
        "What can you tell me about {place}?", "Look up details on {place}.",
        "I want to know more about {place}.", "Find details for the {place}."),
        (("get_place_details", (("place_name", "{place}"), ("city", "{city}"), ("category", "{category_arg}"))),)),
    Template("play_podcast", 2, "entertainment", {"show": Pool("podcasts"),
                                                  "speed": Choice((1.0, 1.25, 1.5, None, None)),
                                                  "speed_arg": NullIf("speed", 1.0)}, (
        "Play the podcast '{show}'.", "Put on an episode of {show}.", "I want to listen to the {show} podcast.",
        "Play the latest episode of {show}.", "Start {show}.", "Queue up {show} podcast for me."),
        (("play_podcast", (("show_name", "{show}"), ("playback_speed", "{speed_arg}"))),)),
    Template("run_code", 3, "code", {"snip": Pool("snippets")}, (
        "Run this {snip.lang} code: {snip.code}", "Execute the following {snip.lang} snippet: {snip.code}",
        "Can you run this {snip.lang} for me? {snip.code}", "Execute: {snip.code}",
        "Run this code ({snip.lang}): {snip.code}"),
        (("run_code", (("code", "{snip.code}"), ("language", "{snip.lang}"))),)),
    # ambiguous single-step pairs
    Template("weather_vs_news", 2, "weather", {"city": Pool("cities")}, (
        "What's happening with the weather in {city}?", "What are the current conditions in {city} outside?",
        "Tell me the latest outdoor conditions in {city}.", "How's {city} looking weather-wise today?"),
        (("get_weather", (("city", "{city}"), ("units", "C"))),)),
    Template("calculate_vs_convert", 2, "conversion", {"conv": Pool("units"), "value": Rounded("conv")}, (
        "Calculate how much {value} {conv.from} is in {conv.to}.", "Compute the {conv.to} equivalent of {value} {conv.from}.",
        "Figure out {value} {conv.from} expressed in {conv.to}.", "Work out: {value} {conv.from} in {conv.to}."),
        (("convert_units", (("value", "{value}"), ("from_unit", "{conv.from}"), ("to_unit", "{conv.to}"))),)),
    Template("search_vs_news", 2, "search", {"topic": Pool("topics")}, (
        "Find the latest information about {topic} online.", "Search for recent developments in {topic}.",
        "Look up what's new with {topic} on the web.", "Get me web results about {topic}."),
        (("search_web", (("query", "{topic}"), ("num_results", 5))),)),
    Template("weather_vs_forecast", 3, "weather", {"city": Pool("cities"), "days": Choice((3, 5, 7))}, (
        "What will the weather be like in {city} next week?", "Is it going to rain in {city} this weekend?",
        "What should I expect weather-wise in {city} over the next {days} days?",
        "Will {city} be warm or cold in the coming days?", "Give me an idea of upcoming weather in {city}."),
        (("get_weather_forecast", (("city", "{city}"), ("days", "{days}"), ("units", "C"))),)),
    Template("sms_vs_email", 3, "communication", {"phone": Pool("phones"), "msg": Pool("amb_sms")}, (
        "Message {phone}: {msg}", "Send a quick message to {phone} saying '{msg}'.", "Ping {phone} with: {msg}",
        "Drop a message to {phone}: {msg}"),
        (("send_sms", (("phone_number", "{phone}"), ("message", "{msg}"))),)),
    Template("task_vs_reminder", 3, "productivity", {"title": Pool("amb_tasks"), "priority": Choice(("medium", "high"))}, (
        "Don't let me forget to {title|lower}. Add it to my tasks.", "I need to {title|lower} — put it on my list.",
        "Add '{title}' to my to-do list.", "Note to self: {title}. Add it as a task.",
        "Log '{title}' as something I need to do."),
        (("add_task", (("title", "{title}"), ("priority", "{priority}"))),)),
    Template("convert_vs_rate", 3, "finance", {"cur": Pair("currencies", 0, 10), "amount": Choice((100, 500, 1000))}, (
        "How much is {amount} {cur.first} in {cur.second}?", "If I have {amount} {cur.first}, how much {cur.second} is that?",
        "Convert {amount} {cur.first} into {cur.second}.", "I want to change {amount} {cur.first} to {cur.second}."),
        (("convert_currency", (("amount", "{amount}"), ("from_currency", "{cur.first}"),
                               ("to_currency", "{cur.second}"))),)),
    Template("stock_current_vs_history", 3, "finance", {"ticker": Pool("tickers"), "start": Pool("dates", 0, 5)}, (
        "Show me {ticker}'s performance over the past 3 months.", "How has {ticker} done since {start}?",
        "What were {ticker}'s prices last quarter?", "Give me {ticker}'s price history.",
        "I want to see how {ticker} trended from {start}."),
        (("get_stock_history", (("symbol", "{ticker}"), ("start_date", "{start}"))),)),
    Template("music_vs_podcast", 3, "entertainment", {"show": Pool("podcasts")}, (
        "Play {show}.", "I want to listen to {show}.", "Put on {show}.", "Start {show} for me."),
        (("play_podcast", (("show_name", "{show}"),)),)),
    Template("calculate_vs_run_code", 3, "code", {"snip": Pool("amb_code")}, (
        "Calculate the result of this {snip.lang} program: {snip.code}", "Compute this: {snip.code}",
        "Run and give me the output of: {snip.code}"),
        (("run_code", (("code", "{snip.code}"), ("language", "{snip.lang}"))),)),
]

MULTI = [
    Template("weather_stock", 3, "multi_step", {"city": Pool("cities"), "ticker": Pool("tickers"), "units": C_OR_F}, (
        "Get the current weather in {city} and check the stock price of {ticker}.",
        "What's the weather in {city} and how is {ticker} doing today?",
        "I need two things: weather for {city} and the latest price of {ticker}.",
        "Check {city} weather and {ticker} stock for me."),
        (("get_weather", (("city", "{city}"), ("units", "{units}"))),
         ("get_stock_price", (("symbol", "{ticker}"),)))),
    Template("news_email", 2, "multi_step", {"topic": Pool("topics"), "to": Pool("people"), "n": Choice((3, 5))}, (
        "Find the latest {n} news articles about {topic} and send a summary to {to}.",
        "Get top {n} news on {topic}, then email {to} with a summary.",
        "Research {topic} in the news and forward the findings to {to}.",
        "Look up recent {topic} news and email {to} about it."),
        (("get_news", (("topic", "{topic}"), ("num_articles", "{n}"))),
         ("send_email", (("to", "{to}"), ("subject", "Latest news: {topic}"),
                         ("body", "Here is a summary of the latest {n} news articles on {topic}."))))),
    Template("directions_hotel", 2, "multi_step", {
        "od": Pair("cities"), "check_in": Pool("dates", 0, 15), "check_out": Pool("dates", 15, None),
        "guests": Int(1, 4), "room": Pool("hotel_types")}, (
        "Get driving directions from {od.first} to {od.second} and book a {room} hotel room there from {check_in} to {check_out}.",
        "I'm travelling from {od.first} to {od.second}. Show me directions and reserve a hotel in {od.second}.",
        "Plan my trip: directions from {od.first} to {od.second}, then book a hotel in {od.second} for {guests} guests.",
        "Navigate from {od.first} to {od.second} and arrange a {room} room in {od.second} ({check_in}–{check_out})."),
        (("get_directions", (("origin", "{od.first}"), ("destination", "{od.second}"))),
         ("book_hotel", (("hotel_name", "Grand Hotel {od.second}"), ("check_in", "{check_in}"),
                         ("check_out", "{check_out}"), ("guests", "{guests}"), ("room_type", "{room}"))))),
    Template("exchange_convert", 2, "multi_step", {"cur": Pair("currencies", 0, 10), "conv": Pool("units", 0, 8),
                                                   "value": Rounded("conv")}, (
        "Get the {cur.first} to {cur.second} exchange rate and also convert {value} {conv.from} to {conv.to}.",
        "I need two conversions: currency {cur.first}/{cur.second} and unit {value} {conv.from} to {conv.to}.",
        "What's {cur.first} in {cur.second}? Also, convert {value} {conv.from} to {conv.to}."),
        (("get_exchange_rate", (("from_currency", "{cur.first}"), ("to_currency", "{cur.second}"))),
         ("convert_units", (("value", "{value}"), ("from_unit", "{conv.from}"), ("to_unit", "{conv.to}"))))),
    Template("search_email", 2, "multi_step", {"query": Pool("searches"), "to": Pool("people"), "n": Choice((5, 10))}, (
        "Search for '{query}' and email the top {n} results to {to}.",
        "Look up '{query}' online and send a summary to {to}.",
        "Find information about {query} and forward it to {to}."),
        (("search_web", (("query", "{query}"), ("num_results", "{n}"))),
         ("send_email", (("to", "{to}"), ("subject", "Search results: {query}"),
                         ("body", "Here are the top {n} results for: {query}"))))),
    Template("weather_reminder", 2, "multi_step", {"city": Pool("cities"), "date": Pool("dates", 0, 10),
                                                  "time": Pool("times"), "msg": Pool("weather_reminders")}, (
        "Check the weather in {city} and set a reminder for '{msg}' on {date} at {time}.",
        "What's the weather in {city}? Also create a reminder: '{msg}' at {time} on {date}.",
        "Get {city} weather and remind me to '{msg}' on {date}."),
        (("get_weather", (("city", "{city}"), ("units", "C"))),
         ("set_reminder", (("message", "{msg}"), ("datetime", "{date}T{time}:00"))))),
    Template("calendar_email_reminder", 3, "multi_step", {
        "title": Pool("meetings"), "date": Pool("dates", 0, 15), "time": Pool("times"), "attendee": Pool("people"),
        "to": Other("people", "attendee"), "msg": Pool("reminders"), "attendees": ListOf("attendee")}, (
        "Schedule a '{title}' on {date} at {time}, email {to} the invite, and set a reminder to prepare beforehand.",
        "Create a calendar event for '{title}' ({date} {time}), then send {to} an email, then remind me about prep.",
        "I need to: (1) add '{title}' to my calendar for {date} at {time}, (2) email {to} about it, (3) set a reminder.",
        "Book '{title}' on {date} at {time} with {attendee}, email {to} the details, and set a '{msg}' reminder."),
        (("create_calendar_event", (("title", "{title}"), ("date", "{date}"), ("time", "{time}"),
                                    ("attendees", "{attendees}"))),
         ("send_email", (("to", "{to}"), ("subject", "Invite: {title} on {date}"),
                         ("body", "You are invited to '{title}' on {date} at {time}. Please confirm attendance."))),
         ("set_reminder", (("message", "Prepare for {title}"), ("datetime", "{date}T08:00:00"))))),
    Template("search_translate_email", 2, "multi_step", {"query": Pool("searches"), "lang": Pool("languages"),
                                                         "to": Pool("people")}, (
        "Search for '{query}', translate the summary to {lang.name}, then email it to {to}.",
        "Look up '{query}', convert the result to {lang.name}, and forward to {to}.",
        "Find info on '{query}', translate it into {lang.name}, then send to {to}."),
        (("search_web", (("query", "{query}"), ("num_results", 5))),
         ("translate_text", (("text", "Search results for: {query}"), ("target_lang", "{lang.code}"))),
         ("send_email", (("to", "{to}"), ("subject", "[{lang.name}] {query}"),
                         ("body", "Translated search results for '{query}' in {lang.name}."))))),
    Template("stock_exchange_calculate", 2, "multi_step", {
        "ticker": Pool("tickers"), "usd": Const("USD"), "to_c": Other("currencies", "usd", 0, 10),
        "shares": Int(1, 100)}, (
        "Get {ticker} stock price, get the {usd}/{to_c} exchange rate, then calculate the value of {shares} shares in {to_c}.",
        "What is {shares} shares of {ticker} worth in {to_c}? Get the stock price, exchange rate, then compute.",
        "Fetch {ticker} price and the {usd} to {to_c} rate, then calculate total for {shares} shares."),
        (("get_stock_price", (("symbol", "{ticker}"), ("currency", "{usd}"))),
         ("get_exchange_rate", (("from_currency", "{usd}"), ("to_currency", "{to_c}"))),
         ("calculate", (("expression", "{shares} * price * rate"),)))),
    Template("research_email", 3, "multi_step", {"query": Pool("searches"), "topic": Pool("topics"),
                                                 "lang": Pool("languages"), "to": Pool("people")}, (
        "Search for '{query}', also grab the latest {topic} news, translate both into {lang.name}, then email {to} a summary.",
        "Research '{query}' via web, get {topic} headlines, translate to {lang.name}, and send to {to}.",
        "Do a web search for '{query}', fetch {topic} news, convert results to {lang.name}, forward to {to}."),
        (("search_web", (("query", "{query}"), ("num_results", 5))),
         ("get_news", (("topic", "{topic}"), ("num_articles", 3))),
         ("translate_text", (("text", "Summary about {query} and {topic}"), ("target_lang", "{lang.code}"))),
         ("send_email", (("to", "{to}"), ("subject", "[{lang.name}] Research: {query} & {topic}"),
                         ("body", "Please find the translated research on {query} and {topic} below."))))),
    Template("trip_plan", 3, "multi_step", {"od": Pair("cities"), "dep": Pool("dates", 0, 10),
                                            "ret": Pool("dates", 15, 25), "time": Pool("times", 0, 6)}, (
        "Plan my trip from {od.first} to {od.second}: book a flight on {dep}, reserve a hotel in {od.second}, get driving directions, and add it to my calendar.",
        "I'm going to {od.second} on {dep}. Book the flight from {od.first}, find a hotel there, get directions around {od.second}, and put the trip in my calendar.",
        "Help me plan: (1) book {od.first}→{od.second} flight for {dep}, (2) reserve a hotel in {od.second}, (3) get directions, (4) create a calendar event."),
        (("book_flight", (("origin", "{od.first}"), ("destination", "{od.second}"), ("departure_date", "{dep}"))),
         ("book_hotel", (("hotel_name", "Grand Hotel {od.second}"), ("check_in", "{dep}"), ("check_out", "{ret}"),
                         ("guests", 1))),
         ("get_directions", (("origin", "{od.first}"), ("destination", "{od.second}"), ("mode", "driving"))),
         ("create_calendar_event", (("title", "Trip to {od.second}"), ("date", "{dep}"), ("time", "{time}"))))),
    Template("market_report", 2, "multi_step", {
        "ticker": Pool("tickers"), "usd": Const("USD"), "to_c": Choice(("EUR", "GBP", "JPY", "CAD")),
        "shares": Int(10, 200), "start": Pool("dates", 0, 5), "to": Pool("people")}, (
        "Build a market report for {ticker}: get current price, pull history from {start}, get {usd}/{to_c} rate, compute value of {shares} shares in {to_c}, then email the report to {to}.",
        "For {shares} shares of {ticker}: fetch current price, historical data since {start}, {usd}-to-{to_c} exchange rate, calculate total {to_c} value, then send the report to {to}.",
        "Compile a {ticker} report — price now, price history, {usd}/{to_c} rate, {shares}-share valuation in {to_c} — and email it to {to}."),
        (("get_stock_price", (("symbol", "{ticker}"), ("currency", "{usd}"))),
         ("get_stock_history", (("symbol", "{ticker}"), ("start_date", "{start}"))),
         ("get_exchange_rate", (("from_currency", "{usd}"), ("to_currency", "{to_c}"))),
         ("calculate", (("expression", "{shares} * price * rate"),)),
         ("send_email", (("to", "{to}"), ("subject", "Market report: {ticker} value in {to_c}"),
                         ("body", "Attached is the market analysis for {shares} shares of {ticker} valued in {to_c}."))))),
    Template("event_coordination", 2, "multi_step", {
        "city": Pool("cities"), "date": Pool("dates", 0, 10), "time": Pool("times"), "attendee": Pool("people"),
        "to": Other("people", "attendee"), "title": Pool("events"), "attendees": ListOf("attendee")}, (
        "Plan '{title}' in {city} on {date}: check the forecast, create the calendar event, invite {to}, set a reminder, and add a prep task.",
        "Organise '{title}' in {city} ({date}): (1) weather forecast, (2) calendar event, (3) email invite to {to}, (4) reminder, (5) prep task.",
        "For '{title}' on {date} in {city}: forecast first, then calendar block, email {to}, reminder to prepare, and log a prep task."),
        (("get_weather_forecast", (("city", "{city}"), ("days", 3), ("units", "C"))),
         ("create_calendar_event", (("title", "{title}"), ("date", "{date}"), ("time", "{time}"),
                                    ("attendees", "{attendees}"))),
         ("send_email", (("to", "{to}"), ("subject", "Invitation: {title} on {date}"),
                         ("body", "You are invited to {title} in {city} on {date} at {time}."))),
         ("set_reminder", (("message", "Prepare for {title}"), ("datetime", "{date}T08:00:00"))),
         ("add_task", (("title", "Prepare {title} materials"), ("priority", "high"))))),
]

# Relative weights are multiplied by 50 in the reference; the shares are the same.
TEMPLATES = SINGLE + MULTI
