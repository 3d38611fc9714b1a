"""Fixed values that results depend on: word lists, limits and weights of the retrieval engine."""

#: Words that whitespace tokens of a question are dropped for (fixed values).
STOP_WORDS = (
    "알려줘", "보여줘", "찾아줘", "찾아", "관련", "포함", "포함된", "코드", "코드라인", "라인", "부분", "위치", "어디", "어느",
    "있는", "나오는", "사용하는", "사용된", "호출", "호출부", "정의", "정의된", "메서드", "함수", "클래스", "문자열",
    "조회", "검색", "전체", "목록", "출력", "좀", "이", "가", "을", "를", "은", "는", "의", "에서", "으로", "로", "와", "과",
)
#: Words that identifiers of a question are dropped for (fixed values).
SKIPPED_IDENTIFIERS = ("code", "line", "lines", "method", "class", "function", "find", "show", "search", "keyword")
#: Words that are no keywords, whatever they come from (fixed values).
BANNED_KEYWORDS = ("코드", "라인", "부분", "위치", "어디", "관련", "포함", "포함된", "사용", "사용된", "정의", "호출", "조회", "검색", "목록", "전체")
#: Particles cut off the end of a token, in this order (fixed values).
PARTICLES = ("이", "가", "을", "를", "은", "는", "의", "에", "에서", "으로", "로", "와", "과", "도", "만", "좀")
#: Substrings that make a question one about structure (fixed values).
STRUCTURE_QUESTION = (
    "구조", "흐름", "연결", "관계", "역할", "아키텍처", "패키지", "전체", "프로젝트", "시스템", "주고받", "오가", "호출 순서",
    "flow", "flows", "structure", "architecture", "relationship", "relationships", "connect", "connected", "overview",
)
#: Substrings of a question that earn a hit the structure bonus (fixed values).
STRUCTURE_BONUS = (
    "구조", "아키텍처", "패키지", "디렉터리", "폴더", "트리", "구성", "레이어",
    "structure", "architecture", "package", "packages", "directory", "directories", "folder", "folders", "tree", "layout",
)
#: Words of paths that count for the structure bonus (fixed values).
PATH_WORDS = (
    "controller", "service", "repository", "repo", "handler", "router", "api", "config", "auth", "login", "security",
    "user", "admin", "payment", "order", "product", "dto", "entity", "model",
)
#: Suffixes of source files (fixed values).
CODE_SUFFIXES = (
    ".java", ".kt", ".py", ".js", ".ts", ".tsx", ".jsx", ".xml", ".yml", ".yaml", ".properties", ".sql",
    ".cpp", ".c", ".cs", ".go", ".rb", ".php",
)

MAX_KEYWORDS = 8
RETRIEVAL_LIMIT = 30
RERANK_LIMIT = 12
KEYWORD_HITS = 200
KEYWORD_HITS_PER_REPO = 50
CONTEXT_CHARS = 12_000
MERGE_GAP = 5
CONTEXT_HEADER = "[참고 발췌]"

#: Marks of source lines that tell what a program does (fixed values).
CODE_MARKERS = (
    "@RequestMapping", "@PostMapping", "@GetMapping", "ServerSocket", "MulticastSocket", "DatagramPacket", "RestClient", "RestTemplate",
    "sendData(", "sendRequestMsg(", "receive(", "TcpSender", "UdpSend", "Receiver", "Listener", "Queue", "heartbeat", "diagnosis",
)
#: Parts of settings' keys that are of interest (fixed values).
CONFIG_WORDS = ("port", "url", "host", "ip", "mode")
#: Words counted for what a repository does (fixed values).
OUTBOUND_WORDS = ("send", "sender", "client", "publish", "post", "restclient", "resttemplate")
INBOUND_WORDS = ("receive", "receiver", "listener", "serversocket", "multicastsocket", "@requestmapping", "@postmapping")
TRANSFORM_WORDS = ("parse", "parser", "encode", "decode", "queue", "poll", "handler")
#: Words of paths and of signal lines counted for each part a file may play (fixed values).
ROLE_WORDS = {
    "entry": (("main", "application", "bootstrap", "startup", "cli"), ("public static void main", "springapplication.run", "fastapi(", "express()", "uvicorn.run")),
    "input": (
        ("controller", "route", "router", "endpoint", "handler", "listener", "receiver", "consumer", "subscriber", "webhook", "api", "requestmapping",
         "postmapping", "getmapping", "messagepattern", "serversocket", "multicastsocket"),
        ("@requestmapping", "@postmapping", "@getmapping", "router.", "app.", "serversocket", "multicastsocket"),
    ),
    "process": (
        ("service", "usecase", "processor", "orchestr", "workflow", "manager", "engine", "parse", "parser", "transform", "decode", "encode", "queue", "poll", "handler"),
        ("queue", "handler", "process", "transform", "parser", "decode", "encode"),
    ),
    "output": (
        ("sender", "client", "producer", "publisher", "gateway", "adapter", "proxy", "emit", "dispatch", "deliver", "forward", "restclient", "resttemplate", "send"),
        ("restclient", "resttemplate", "senddata(", "sendrequestmsg(", "publish", "forward", "dispatch"),
    ),
}
#: Words of a sender's and a receiver's signal lines that make a relation (fixed values).
RESEND_WORDS = ("udpsend", "senddata(", "restclient", "resttemplate", "client")
SEND_WORDS = ("sender", "send")
RECEIVE_WORDS = ("receiver", "listener", "serversocket", "multicastsocket")
SIGNALS_PER_FILE = 12
SIGNAL_CHARS = 180
PAIRS_PER_FILE = 40
ROLE_SCORE = 2
ROLE_FILES = 4
RELATIONS = 8
