"""Word and pattern tables of the pattern and taint operators. All of this module is fixed values."""

from __future__ import annotations

# Words of each cross-cutting concern.
CONCERNS = {
    "error_handling": ("try", "catch", "except", "raise", "throw", "Error", "Exception", "panic", "recover", "unwrap", "expect", "err", "error"),
    "logging": ("log", "logger", "logging", "console.log", "console.error", "console.warn", "fmt.Print", "fmt.Errorf", "log.Print", "Log.", "LOG", "debug", "info", "warn"),
    "authentication": ("auth", "token", "session", "permission", "credential", "login", "logout", "jwt", "oauth", "cookie", "Bearer", "authenticate", "authorize"),
    "caching": ("cache", "Cache", "redis", "memcache", "ttl", "expire", "invalidate", "evict", "lru", "memoize"),
}

# Words of names that mirror each other, left and right.
MIRRORS = (
    (("serialize", "marshal", "encode", "encrypt", "compress", "pack", "stringify"), ("deserialize", "unmarshal", "decode", "decrypt", "decompress", "unpack", "parse")),
    (("save", "store", "write", "put", "set", "insert", "create"), ("load", "fetch", "read", "get", "delete", "remove", "destroy")),
    (("to_json", "toJSON", "to_dict", "toMap", "to_string", "ToString"), ("from_json", "fromJSON", "from_dict", "fromMap", "from_string", "FromString")),
    (("open", "start", "begin", "connect", "init", "setup", "mount"), ("close", "stop", "end", "disconnect", "cleanup", "teardown", "unmount")),
    (("subscribe", "register", "bind", "attach", "listen", "on"), ("unsubscribe", "unregister", "unbind", "detach", "unlisten", "off")),
    (("request", "send", "upload", "push", "produce", "emit"), ("response", "receive", "download", "pull", "consume", "handle")),
    (("lock", "acquire", "enter"), ("unlock", "release", "exit")),
    (("increment", "increase", "add", "deposit"), ("decrement", "decrease", "subtract", "withdraw")),
)

# Words of paths and the layers they name.
LAYERS = (
    ("handler", "Handler"), ("controller", "Controller"), ("route", "Route"), ("api", "API"), ("view", "View"), ("service", "Service"), ("usecase", "UseCase"), ("domain", "Domain"), ("model", "Model"), ("entity", "Entity"),
    ("repository", "Repository"), ("dao", "DAO"), ("db", "Database"), ("store", "Store"), ("migration", "Migration"), ("middleware", "Middleware"), ("util", "Utility"), ("helper", "Helper"), ("cmd", "Command"), ("pkg", "Package"),
)

# What opens something, what closes it, and what its absence is called.
PAIRS = (
    (("open(", "fopen(", "Open(", "OpenFile("), ("close(", "fclose(", "Close(", ".close()"), "file open without close"),
    ((".lock(", "Lock(", "acquire(", "mutex.lock", "RLock("), (".unlock(", "Unlock(", "release(", "mutex.unlock", "RUnlock("), "lock without unlock"),
    (("connect(", "Connect(", "dial(", "Dial(", "createConnection"), ("disconnect(", "Disconnect(", "close(", "Close(", "closeConnection"), "connection opened without close"),
    (("subscribe(", "addEventListener(", "on(", "addListener("), ("unsubscribe(", "removeEventListener(", "off(", "removeListener("), "event subscription without unsubscribe"),
    (("begin(", "beginTransaction(", "startTransaction(", "BEGIN"), ("commit(", "rollback(", "endTransaction(", "COMMIT", "ROLLBACK"), "transaction begin without commit/rollback"),
    (("malloc(", "calloc(", "realloc(", "alloc(", "new "), ("free(", "dealloc(", "delete ", "release("), "allocation without free"),
    (("setInterval(", "setTimeout("), ("clearInterval(", "clearTimeout("), "timer set without clear"),
    (("push(", "append(", "add(", "enqueue("), ("pop(", "remove(", "dequeue("), "item added without removal path"),
    (("startSpan(", "beginSpan(", "startTimer("), ("endSpan(", "finishSpan(", "stopTimer("), "span/timer started without end"),
    (("defer ",), ("defer ",), "resource acquisition without defer cleanup (Go)"),
    (("kmalloc(", "kzalloc(", "vmalloc("), ("kfree(", "vfree("), "kernel allocation without free"),
    (("dma_alloc_coherent(",), ("dma_free_coherent(",), "DMA allocation without free"),
    (("request_irq(", "request_threaded_irq("), ("free_irq(",), "IRQ registered without free"),
    (("spin_lock(", "spin_lock_irqsave("), ("spin_unlock(", "spin_unlock_irqrestore("), "spinlock without unlock"),
    (("clk_prepare_enable(",), ("clk_disable_unprepare(",), "clock enabled without disable"),
    (("platform_driver_register(",), ("platform_driver_unregister(",), "platform driver registered without unregister"),
    (("of_node_get(", "of_find_node_by_name(", "of_find_node_by_type(", "of_find_compatible_node("), ("of_node_put(",), "device tree node get without put"),
    (("mutex_lock(",), ("mutex_unlock(",), "kernel mutex lock without unlock"),
    (("rtnl_lock(",), ("rtnl_unlock(",), "rtnl lock without unlock"),
    (("kstrdup(",), ("kfree(",), "kstrdup allocation without kfree"),
    (("kmem_cache_alloc(",), ("kmem_cache_free(",), "slab cache allocation without free"),
    (("rcu_read_lock(",), ("rcu_read_unlock(",), "RCU read lock without unlock"),
    (("pthread_mutex_lock(",), ("pthread_mutex_unlock(",), "pthread mutex lock without unlock"),
    (("sem_wait(", "sem_trywait(", "sem_timedwait("), ("sem_post(",), "semaphore wait without post"),
    (("mmap(",), ("munmap(",), "mmap without munmap"),
    (("=open(", "openat(", "creat("), ("close(",), "POSIX file descriptor opened without close"),
    (("opendir(", "fdopendir("), ("closedir(",), "directory opened without closedir"),
    (("pthread_rwlock_rdlock(", "pthread_rwlock_wrlock("), ("pthread_rwlock_unlock(",), "pthread rwlock without unlock"),
    (("threading.Lock(", "threading.RLock("), (".release(",), "Python threading lock without release"),
    (("pool.apply_async(", "pool.map_async(", "Pool("), ("pool.close(", "pool.terminate(", "pool.join("), "Python multiprocessing pool without close/join"),
    (("socket.socket(", "socket("), (".close(", "close("), "socket created without close"),
    (("tempfile.mkstemp(", "tempfile.NamedTemporaryFile("), ("os.close(", "os.unlink(", "os.remove(", ".close("), "temporary file without cleanup"),
    (("createReadStream(", "createWriteStream("), (".destroy(", ".close(", ".end("), "Node.js stream without destroy/close/end"),
    (("createServer(",), ("server.close(", ".close("), "server created without close"),
    (("pool.connect(", "pool.query("), ("client.release(", ".release(", "pool.end("), "database pool connection without release"),
    (("fs.open(", "fs.openSync("), ("fs.close(", "fs.closeSync("), "fs.open without fs.close"),
    (("acquire(", "lock("), ("release(", "unlock("), "lock/acquire without release/unlock"),
    (("sql.Open(",), ("db.Close(", ".Close("), "Go sql.Open without db.Close"),
    (("os.Create(", "os.OpenFile("), (".Close(",), "Go file created without Close"),
    (("context.WithCancel(", "context.WithTimeout(", "context.WithDeadline("), ("cancel(",), "Go context without cancel (may leak goroutine)"),
    ((".Add(",), (".Wait(",), "WaitGroup Add without Wait"),
    (("http.Get(", "http.Post(", "http.Do("), (".Body.Close(", "Body.Close("), "Go HTTP response body not closed"),
    (("File::open(", "File::create(", "OpenOptions"), ("drop(", ".flush("), "Rust file opened without explicit flush/drop"),
    ((".lock()", "Mutex::lock(", "RwLock::read(", "RwLock::write("), ("drop(",), "advisory: Rust mutex lock held to end of scope (explicit drop() releases sooner)"),
    (("unsafe {", "unsafe{"), ("assert!", "debug_assert!", "assert_eq!", "assert_ne!", "// SAFETY", "// Safety"), "unsafe block without safety assertion or comment"),
    (("TcpListener::bind(", "TcpStream::connect("), (".shutdown(", "drop("), "Rust TCP connection without shutdown/drop"),
    (("Command::new(",), (".status()", ".output()", ".spawn("), "Rust Command created but never executed"),
    (("io.open(",), (":close(", "io.close("), "Lua file opened without close"),
    (("socket.tcp", "socket.udp", "socket.connect"), (":close",), "Lua socket opened without close"),
    (("coroutine.create(",), ("coroutine.resume(",), "Lua coroutine created but never resumed"),
    (("aws_s3_bucket",), ("aws_s3_bucket_server_side_encryption_configuration",), "S3 bucket missing encryption configuration"),
    (("aws_s3_bucket",), ("aws_s3_bucket_public_access_block",), "S3 bucket missing public access block"),
    (("aws_s3_bucket",), ("aws_s3_bucket_versioning",), "S3 bucket missing versioning configuration"),
    (("aws_lambda_function",), ("aws_cloudwatch_log_group",), "Lambda function missing CloudWatch log group"),
    (("aws_security_group",), ("aws_security_group_rule",), "Security group missing explicit rule resource"),
    (("aws_db_instance",), ("storage_encrypted",), "RDS instance missing storage_encrypted configuration"),
    (("mktemp",), ("rm ", "rm -", "unlink "), "Temp file created with mktemp but never cleaned up"),
    (("mount ",), ("umount ",), "Filesystem mounted but never unmounted"),
    (("pushd ",), ("popd",), "pushd without matching popd"),
    (("trap ",), ("trap -", "trap ''", 'trap ""'), "Signal trap set but never restored/cleared"),
    (("exec 3>", "exec 3>>", "exec 4>", "exec 4>>"), ("exec 3>&-", "exec 4>&-"), "File descriptor opened but never closed"),
    (("flock ", "lockfile "), ("flock -u", "rm -f /tmp/*.lock", "rm -f /var/lock"), "Lock file acquired but never released"),
    (("mtd write", "mtd -r write"), ("sha256sum", "md5sum", "sha1sum", "verify", "hash"), "Firmware flash write (mtd) without hash verification"),
    (("uci set",), ("uci commit",), "UCI config set without commit"),
    (("insmod ", "modprobe "), ("rmmod ", "modprobe -r"), "Kernel module loaded without unload in cleanup path"),
)

# Texts that show that something is cleaned up without a closing call.
CLEANUP = ("defer ", "finally", "with ", "std::lock_guard", "std::unique_lock", "std::scoped_lock", "std::unique_ptr", "std::shared_ptr", "std::make_unique", "std::make_shared", "std::fstream", "std::ifstream", "std::ofstream")

# Texts by which a line's values are told apart by origin, in the order in which the origins are tried. A
# leading ~ asks for a word boundary before the first occurrence.
ORIGINS = (
    ("Constant", ('= "', "= '", "= 0", "= 1", "= true", "= false", "= nil", "= null", "= None", "= []", "= {}", "= ()")),
    (
        "UserInput",
        (
            "request", "req.", "~body", "~params", "~query", "~form", "~input", "~stdin", "~args", "argv", "request.form", "request.json", "request.data", "request.GET", "request.POST", "request.FILES", "sys.stdin", "raw_input(", "input(",
            "getParameter", "event.target", "prompt(", "readline", "document.cookie", "window.location", "location.hash", "location.search", "URLSearchParams", "req.cookies", "req.headers", "req.socket", "ReadBody", "FormValue", "PostForm",
            "r.Body", "r.URL.Query", "r.Header", "r.FormFile", "r.MultipartForm", "bufio.NewReader", "bufio.NewScanner", "std::io::stdin", "BufReader", "TcpStream", "UdpSocket", "hyper::body", "axum::extract", "actix_web::web", "rocket::form",
            "io.read", "io.stdin", "socket.receive", "ngx.req", "ngx.var", "recv(", "recvfrom(", "recvmsg(", "read(", "fgets(", "fread(", "scanf(", "fscanf(", "sscanf(", "gets(", "getline(", "getchar(", "fgetc(", "accept(", "ntohs(", "ntohl(",
            "ntohll(", "copy_from_user(", "__copy_from_user(", "get_user(", "__get_user(", "copy_from_iter(", "->get_str(", "->get_int(", "->get_bool(", "var.", "variable ", "$1", "$2", "$@", "$*", "read ", "read -", "$(curl ", "$(curl -",
            "$(wget ", "$(wget -", "`curl ", "`wget ",
        ),
    ),
    (
        "Database",
        (
            ".query", "~execute", "~fetch", "~cursor", "find(", "findOne", "~select", "SELECT", "db.", "DB.", "repository", "dao", "store.get", "session.query", "objects.filter", "objects.get", "objects.all", "cursor.execute", "cursor.fetchone",
            "cursor.fetchall", "Model.select", "Model.find", "Model.findOne", "prisma.", "knex(", "connection.query", "collection.find", "collection.aggregate", "sql.Query", "sql.QueryRow", "db.Query", "db.QueryRow", "rows.Scan", "tx.Query",
            "gorm.Find", "gorm.First", "diesel::", "sqlx::query", "sea_orm::", "rusqlite::", ".fetch_one(", ".fetch_all(", ".fetch_optional(", "conn:execute", "cursor:fetch", "redis:get", "redis:hgetall", "mysql_query(", "mysql_real_query(",
            "mysql_store_result(", "mysql_fetch_row(", "sqlite3_exec(", "sqlite3_step(", "PQexec(", "PQexecParams(", "data.", 'data "',
        ),
    ),
    (
        "Hardware",
        ("ioctl(", "mmap(", "inb(", "outb(", "readl(", "writel(", "readb(", "writeb(", "readw(", "writew(", "ioread32(", "iowrite32(", "of_property_read", "platform_get_irq(", "platform_get_resource(", "devm_ioremap(", "regmap_read(", "regmap_write("),
    ),
    (
        "Config",
        (
            "config", "Config", "settings", "Settings", "getConfig", "get_config", "cfg.", "conf.", "properties", "yaml", "toml", "configparser", "json.load", "yaml.safe_load", "toml.load", "django.conf", "require('config')", "JSON.parse",
            "yaml.parse", "fs.readFileSync", "viper.", "flag.", "toml.Decode", "yaml.Unmarshal", "json.Unmarshal", "serde_json::from", "serde_yaml::from", "toml::from_str", "config::Config", "Figment", "dofile(", "getopt(", "fopen(", "source ",
            ". /", "local.", "locals ", "module.",
        ),
    ),
    (
        "EnvVar",
        ("os.environ", "os.getenv", "process.env", "dotenv", "os.Getenv", "os.LookupEnv", "System.getenv", "env.", "ENV[", "std::env::var", "std::env::args", "dotenvy::", "os.getenv", "getenv(", "argv[", "argv "),
    ),
)

# The severity of each origin.
ORIGIN_SEVERITY = {"UserInput": "concern", "Hardware": "concern", "Database": "warning", "ExternalCall": "warning", "FunctionParam": "info", "EnvVar": "info", "Config": "info"}

# Modules whose names do come from users, and local names that only count if they come from those.
WEB_MODULES = ("flask", "django", "fastapi", "starlette", "aiohttp", "requests", "bottle", "tornado", "sanic", "quart", "litestar", "werkzeug", "httpx")
SHADOWED = ("request", "req", "form", "query", "body", "params", "args", "input", "stdin", "data")

# Texts near a call that show that its result is handled.
HANDLED = (
    "if ", "guard ", "switch ", "match ", "!= nil", "== nil", "if err != nil", "if err == nil", "errors.Is(", "errors.As(", "!= None", "== None", "is None", "is not None", "except", "with ", "assert ", "!= null", "!== null", "!== undefined",
    "== null", "=== null", "=== undefined", "?.", "??", ".catch(", ".ok()", ".unwrap_or", ".unwrap_or_else", ".unwrap_or_default", ".map_err(", ".and_then(", ".or_else(", "if let Some(", "if let Ok(", "if let Err(", "if (ret ", "if (rc ",
    "if (err ", "if (status ", "if (result ", "if (!", "== NULL)", "!= NULL)", "== nullptr)", "!= nullptr)", "errno", "perror(", "strerror(", "assert(", "ASSERT_", "CHECK_", "pcall(", "xpcall(", "try ", "catch", "or ", "|| ", "getOrElse", "orElse",
)

# Texts near a call from another file that show that it is guarded.
GUARDED = (
    "try", "catch", "except", "if err", "if error", ".catch(", "raise_for_status(", "raise ", "throw ", "Promise.reject", ".finally(", "errors.Is(", "errors.As(", "log.Fatal", "log.Panic", "panic(", "if (ret < 0)", "if (ret == -1)",
    "if (ret != 0)", "if (rc < 0)", "if (rc != 0)", "if (status < 0)", "if (result < 0)", "if (!", "if (NULL", "== NULL)", "!= NULL)", "if (ptr == NULL", "== nullptr)", "!= nullptr)", "errno", "perror(", "strerror(", "assert(", "ASSERT_",
    "CHECK_", "WARN_ON(", "WARN_ON_ONCE(", "BUG_ON(", "throw ", "catch (", "catch(", "noexcept", "std::exception", "unique_ptr", "shared_ptr", "make_unique", "make_shared", "lock_guard", "unique_lock", "scoped_lock", ".has_value(",
    ".value_or(", "std::optional", "std::expected", "std::error_code", "std::errc", "if (err", ")?", ".unwrap(", ".expect(", ".unwrap_or(", ".unwrap_or_else(", "if let Err(", "if let Ok(", "match ", ".map_err(", "Err(", "pcall(", "xpcall(",
    "assert(", "error(",
)

# Names that a tainted value must not reach. A leading = asks for the whole name, else a part is enough.
FLAT_SINKS = (
    "exec", "eval", "system", "query", "execute", "raw_sql", "=open", "write", "unlink", "remove", "rmdir", "send", "respond", "render", "redirect", "BUILD_FROM_FILE", "strcpy", "strcat", "strncpy", "sprintf", "vsprintf", "gets", "scanf",
    "memcpy", "memmove", "execv", "execve", "execvp", "dlopen", "fopen", "free", "printf", "fprintf", "snprintf", "vprintf", "vfprintf", "vsprintf", "vsnprintf", "=Popen", "=popen", "=run", "=check_call", "=check_output", "=compile",
    "render_template_string", "mark_safe", "=Markup", "=getattr", "=setattr", "innerHTML", "outerHTML", "dangerouslySetInnerHTML", "insertAdjacentHTML", "Function", "spawn", "execFile", "execSync", "spawnSync", "writeFile", "writeFileSync",
    "unlinkSync", "rmdirSync", "appendFile", "appendFileSync", "=raw", "=literal", "Command", "Exec", "=HTML", "Fprintf", "Sprintf", "Remove", "RemoveAll", "WriteFile", "Rename", "Chmod", "Query", "QueryRow", "=transmute", "from_raw_parts",
    "=write_volatile", "=read_volatile", "from_utf8_unchecked", "set_permissions", "sql_query", "query_as", "=deserialize", "=CString", "=CStr", "=loadstring", "=dofile", "=loadfile", "cidr_blocks", "ipv6_cidr_blocks", "ingress", "egress",
    "=policy", "assume_role_policy", "user_data", "user_data_base64", "=inline", "=command", "iam_instance_profile", "role_arn", "=eval", "=source", "xargs", "=su", "=sudo", "=chmod", "=chown", "sqlite3", "=curl", "=wget", "=exec", "=awk",
    "=sed", "=find", "=mtd", "=fw_setenv", "=fw_printenv", "=uci", "=iptables", "=ip6tables", "=ifconfig", "=ip", "=brctl", "=bridge", "=vconfig", "=swconfig", "=insmod", "=modprobe", "=rmmod", "procd_set_param", "syslog", "=openlog",
    "sendto", "sendmsg", "copy_from_user", "get_user", "__get_user", "=ioctl", "copy_to_user", "put_user",
)

# Calls that a tainted argument must not reach: languages, category, tainted arguments, what else must hold,
# and the calls.
_JS = ("javascript", "typescript", "tsx")
STRUCTURED_SINKS = (
    (("go",), "OsCommand", (2,), "shell", ("exec.Command",)),
    (("go",), "OsCommand", (3,), "shell", ("exec.CommandContext",)),
    (("go",), "OsCommand", (0,), None, ("exec.Command",)),
    (("go",), "OsCommand", (1,), None, ("exec.CommandContext",)),
    (("go",), "OsCommand", (0, 1), None, ("syscall.Exec",)),
    (("go",), "PathTraversal", (0,), None, ("os.Open", "os.OpenFile", "os.ReadFile", "ioutil.ReadFile", "os.Create", "os.WriteFile", "ioutil.WriteFile", "os.Remove", "os.RemoveAll", "os.Mkdir", "os.MkdirAll")),
    (("go",), "PathTraversal", (0, 1), None, ("os.Rename",)),
    (("go",), "PathTraversal", (2,), None, ("http.ServeFile",)),
    (("go",), "PathTraversal", (0,), None, ("c.File",)),
    (("python",), "Xss", (0,), None, ("mark_safe", "Markup", "markupsafe.Markup", "format_html")),
    (("python",), "Xss", (1,), None, ("render_template_string",)),
    (("python",), "Sqli", (0,), "sql", ("execute", "executemany", "raw")),
    (("python",), "Ssrf", (0,), None, ("requests.get", "requests.post", "requests.put", "requests.delete", "requests.patch", "requests.head", "requests.options", "urllib.request.urlopen", "urllib.request.Request")),
    (("python",), "Ssrf", (1,), None, ("requests.request", "urllib3.PoolManager.request", "httpx.request", "aiohttp.request", "aiohttp.ClientSession.request")),
    (("python",), "Ssrf", (0,), None, ("httpx.get", "httpx.post", "httpx.put", "httpx.delete", "httpx.patch", "httpx.head", "httpx.options")),
    (("python",), "Ssrf", (0,), None, ("aiohttp.ClientSession.get", "aiohttp.ClientSession.post", "aiohttp.ClientSession.put", "aiohttp.ClientSession.delete", "aiohttp.ClientSession.patch", "aiohttp.ClientSession.head", "aiohttp.ClientSession.options")),
    (("python",), "Deserialization", (0,), None, ("pickle.loads", "pickle.load", "cPickle.loads", "cPickle.load", "cloudpickle.loads", "cloudpickle.load", "jsonpickle.decode", "marshal.loads", "marshal.load", "dill.loads", "dill.load")),
    (("python",), "Deserialization", (0,), "yaml", ("yaml.load",)),
    (_JS, "Xss", (1,), None, ("insertAdjacentHTML",)),
    (_JS, "Xss", (0,), None, ("dangerouslySetInnerHTML",)),
    (_JS, "Sqli", (0,), "sql", ("query", "execute")),
    (_JS, "Sqli", (0,), None, ("raw", "literal", "$where", "$queryRawUnsafe", "$executeRawUnsafe")),
    (_JS, "Ssrf", (0,), None, ("fetch", "get", "post", "axios", "got")),
    (_JS, "Ssrf", (0, 1), None, ("request",)),
    (_JS, "Deserialization", (0,), None, ("unserialize", "deserialize", "eval", "Function", "runInNewContext", "runInThisContext", "runInContext", "Script")),
    (_JS, "Deserialization", (0,), "yaml", ("yaml.load", "load")),
    (_JS, "OsCommand", (0,), None, ("exec", "execSync")),
    (_JS, "OsCommand", (0, 1), "shell true", ("spawn", "spawnSync")),
    (_JS, "PathTraversal", (0,), None, ("readFile", "readFileSync", "writeFile", "writeFileSync", "createReadStream", "createWriteStream", "unlink", "rm", "rename", "sendFile", "download")),
)

# Calls that clean a value: languages, category, call, and the call that must stand beside it.
SANITIZERS = (
    (("go",), "PathTraversal", "filepath.Clean", "strings.HasPrefix"),
    (("go",), "PathTraversal", "filepath.Rel", "strings.HasPrefix"),
    (_JS, "Xss", "DOMPurify.sanitize", None),
    (_JS, "Xss", "escapeHtml", None),
    (_JS, "Xss", "escape", None),
    (("python",), "Xss", "html.escape", None),
    (("python",), "Xss", "markupsafe.escape", None),
    (("python",), "Xss", "escape", None),
    (("python",), "Xss", "bleach.clean", None),
    (("python",), "Xss", "bleach.linkify", None),
)

# Texts that read from another process in C and C++, and functions whose wrappers are sinks too.
IPC_SOURCES = ("g_hash_table_lookup(", "g_variant_get_", "g_variant_dup_", "dbus_message_get_args(", "dbus_message_iter_get_basic(")
PRINTERS = ("vprintf", "vfprintf", "vsprintf", "vsnprintf", "sprintf", "snprintf", "fprintf", "printf")

# Web frameworks in the order in which they are tried: languages, module that must be imported (a trailing
# * asks for a prefix), texts one of which must stand in the file, and the calls and paths that give a request's data.
FRAMEWORKS = (
    ("nestjs", _JS, ("@nestjs/*",), (), ()),
    ("fastify", _JS, ("fastify",), (), ()),
    ("express", _JS, ("express",), (), ()),
    ("koa", _JS, ("koa", "@koa/router", "koa-router", "@koa/cors"), (), ()),
    ("fastapi", ("python",), ("fastapi", "fastapi.*"), (), ()),
    ("drf", ("python",), ("rest_framework", "rest_framework.*"), ("@api_view", "APIView", "ViewSet"), ()),
    ("flask", ("python",), ("flask", "flask.*"), (), ()),
    ("django", ("python",), ("django", "django.*"), ("def ", "class "), ()),
    ("gin", ("go",), ("github.com/gin-gonic/gin",), ("*gin.Context",), ("c.Param", "c.Query", "c.PostForm", "c.GetHeader", "c.Request.URL.Path")),
    ("gorilla/mux", ("go",), ("github.com/gorilla/mux",), ("mux.Vars(",), ("mux.Vars",)),
    ("net/http", ("go",), ("net/http",), ("*http.Request", "http.HandleFunc", "http.Handle("), ("r.URL.Query", "r.FormValue", "r.PostFormValue", "r.Header.Get", "r.Cookie", "r.URL.Path", "r.URL.RawQuery", "r.PathValue")),
)

# What marks a test file's path.
TEST_PATHS = ("test_", "_test.", "_spec.", "/tests/", "/test/", "Test.")
