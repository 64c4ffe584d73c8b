"""Source fixtures with the findings that they must give, worked out by hand."""

from __future__ import annotations

SOURCES: dict[str, str] = {
    "shop/Catalog.java": """package shop;

public class Catalog {
    private String storePassword = "kx81-orange";
    private String title = "Catalogue";

    public Item byName(String wanted) throws Exception {
        String sql = "SELECT * FROM items WHERE name = '" + wanted + "'";
        return one(statement.executeQuery(sql));
    }

    public Item byNameSafely(String wanted) throws Exception {
        PreparedStatement ps = db.prepareStatement("SELECT * FROM items WHERE name = ?");
        ps.setString(1, wanted);
        return one(ps.executeQuery());
    }

    public Item cleared(String wanted) throws Exception {
        String sql = "SELECT * FROM items WHERE name = '" + wanted + "'";
        sql = "SELECT * FROM items";
        return one(statement.executeQuery(sql));
    }

    public void open() throws Exception {
        db = DriverManager.getConnection(url, "shop", storePassword);
    }
}
""",
    "shop/Page.java": """package shop;

public class Page {
    public void greet(HttpServletRequest req, HttpServletResponse resp) throws IOException {
        String who = req.getParameter("who");
        resp.getWriter().println("<p>Hello " + who + "</p>");
    }

    public void greetSafely(HttpServletRequest req, HttpServletResponse resp) throws IOException {
        String who = req.getParameter("who");
        resp.getWriter().println("<p>Hello " + Encode.forHtml(who) + "</p>");
    }

    public byte[] picture(HttpServletRequest req) throws IOException {
        String name = req.getParameter("name");
        return Files.readAllBytes(Paths.get(name));
    }

    public byte[] pictureSafely(HttpServletRequest req) throws IOException {
        String name = req.getParameter("name");
        Path target = base.resolve(name).normalize();
        if (!target.startsWith(base)) throw new SecurityException();
        return new FileInputStream(new File(target.toString())).readAllBytes();
    }
}
""",
    "shop/Tools.java": """package shop;

public class Tools {
    private static final Set<String> ALLOWED = Set.of("ls", "df");

    public void run(HttpServletRequest req) throws IOException {
        String cmd = req.getParameter("cmd");
        Runtime.getRuntime().exec(cmd);
    }

    public void runAllowed(HttpServletRequest req) throws IOException {
        String cmd = req.getParameter("cmd");
        if (!ALLOWED.contains(cmd)) throw new SecurityException();
        new ProcessBuilder(cmd).start();
    }

    public String newToken() {
        Random r = new Random();
        return Long.toString(r.nextLong());
    }

    public int rollDice() {
        Random r = new Random();
        return r.nextInt(6);
    }

    public byte[] sum(byte[] data) throws Exception {
        return MessageDigest.getInstance("MD5").digest(data);
    }

    public void store(MultipartFile upload) throws IOException {
        upload.transferTo(Paths.get("incoming", "x.bin"));
    }

    public void storeSafely(MultipartFile upload) throws IOException {
        String ext = FilenameUtils.getExtension(upload.getOriginalFilename());
        if (!allowedExtensions.contains(ext)) throw new SecurityException();
        if (upload.getSize() > MAX_UPLOAD) throw new SecurityException();
        if (ImageIO.read(upload.getInputStream()) == null) throw new SecurityException();
        Path target = box.resolve(UUID.randomUUID() + "." + ext);
        upload.transferTo(target);
        target.toFile().setExecutable(false, false);
    }

    public byte[] keep(String password) throws Exception {
        MessageDigest md = MessageDigest.getInstance("SHA-256");
        return md.digest(password.getBytes());
    }
}
""",
    "shop/items.xml": """<?xml version="1.0"?>
<mapper namespace="shop.Items">
  <!-- <select id="old">SELECT * FROM items ORDER BY ${by}</select> -->
  <select id="sorted">SELECT * FROM items ORDER BY ${by}</select>
  <select id="one">SELECT * FROM items WHERE id = #{id}</select>
</mapper>
""",
}

#: (id, type, file, line, function, confidence) by risk: commands, SQL, paths, uploads, scripts, secrets, hashes, random numbers.
EXPECTED: list[tuple[str, str, str, int, str | None, str]] = [
    ("VULN-001", "COMMAND_INJECTION", "shop/Tools.java", 8, "run", "HIGH"),
    ("VULN-002", "SQL_INJECTION", "shop/Catalog.java", 8, "byName", "HIGH"),
    ("VULN-003", "SQL_INJECTION", "shop/items.xml", 4, "sorted", "HIGH"),
    ("VULN-004", "PATH_TRAVERSAL", "shop/Page.java", 16, "picture", "HIGH"),
    ("VULN-005", "DANGEROUS_FILE_UPLOAD", "shop/Tools.java", 32, "store", "HIGH"),
    ("VULN-006", "XSS", "shop/Page.java", 6, "greet", "HIGH"),
    ("VULN-007", "HARDCODED_SECRET", "shop/Catalog.java", 4, None, "HIGH"),
    ("VULN-008", "WEAK_HASH", "shop/Tools.java", 28, "sum", "HIGH"),
    ("VULN-009", "WEAK_HASH", "shop/Tools.java", 46, "keep", "MEDIUM"),
    ("VULN-010", "INSECURE_RANDOM", "shop/Tools.java", 18, "newToken", "MEDIUM"),
]

#: (caller, callees in order of first sight)
EXPECTED_CALLS: list[tuple[str, list[str]]] = [
    ("Catalog.byName", ["one", "executeQuery"]),
    ("Catalog.byNameSafely", ["prepareStatement", "setString", "one", "executeQuery"]),
    ("Catalog.cleared", ["one", "executeQuery"]),
    ("Catalog.open", ["getConnection"]),
    ("Page.greet", ["getParameter", "println", "getWriter"]),
    ("Page.greetSafely", ["getParameter", "println", "getWriter", "forHtml"]),
    ("Page.picture", ["getParameter", "readAllBytes", "get"]),
    ("Page.pictureSafely", ["getParameter", "normalize", "resolve", "startsWith", "readAllBytes", "toString"]),
    ("Tools.run", ["getParameter", "exec", "getRuntime"]),
    ("Tools.runAllowed", ["getParameter", "contains", "start"]),
    ("Tools.newToken", ["toString", "nextLong"]),
    ("Tools.rollDice", ["nextInt"]),
    ("Tools.sum", ["digest", "getInstance"]),
    ("Tools.store", ["transferTo", "get"]),
    ("Tools.storeSafely", ["getExtension", "getOriginalFilename", "contains", "getSize", "read", "getInputStream", "resolve", "randomUUID", "transferTo", "setExecutable", "toFile"]),
    ("Tools.keep", ["getInstance", "digest", "getBytes"]),
]

#: A project whose flows cross methods and files: an interface with one implementation, a field that a constructor injects,
#: a value that a callee returns or masks, markup that a callee builds, guards on the way, an upload that is handed on.
PROJECT: dict[str, str] = {
    "web/Front.java": """package web;

public class Front {
    private final Finder finder;
    private Views views = new Views();
    private Store store;

    public Front(Finder finder, Store stored) {
        this.finder = finder;
        this.store = stored;
    }

    public void search(HttpServletRequest req) {
        String q = req.getParameter("q");
        finder.find(q);
    }

    public void searchFixed(HttpServletRequest req) {
        finder.find("nothing");
    }

    public void sorted(@RequestParam String by) {
        String column = Names.plain(by);
        finder.find(column);
    }

    public void masked(@RequestParam String by) {
        String column = Names.known(by);
        finder.find(column);
    }

    public void page(HttpServletRequest req, HttpServletResponse resp) throws IOException {
        String html = views.row(req.getParameter("name"));
        resp.getWriter().write(html);
    }

    public void pageEscaped(HttpServletRequest req, HttpServletResponse resp) throws IOException {
        String html = views.row(Encode.forHtml(req.getParameter("name")));
        resp.getWriter().write(html);
    }

    public byte[] file(@PathVariable String name) throws IOException {
        return store.open(name);
    }

    public byte[] checkedFile(@PathVariable String name) throws IOException {
        return store.openChecked(name);
    }

    public void run(@RequestParam Order order) throws IOException {
        store.execute(order.getCommand());
    }

    public void runListed(@RequestParam Order order) throws IOException {
        store.executeListed(order.getCommand());
    }

    public void upload(@RequestPart MultipartFile picture) throws IOException {
        store.save(picture);
    }
}
""",
    "web/Finder.java": """package web;

public interface Finder {
    Object find(String name);
}
""",
    "web/FinderImpl.java": """package web;

public class FinderImpl implements Finder {
    private Rows rows;

    public Object find(String name) {
        return rows.byName(name, 1);
    }
}
""",
    "web/Rows.java": """package web;

public class Rows {
    public Object byName(String name, int n) throws SQLException {
        String sql = "SELECT * FROM rows WHERE name = '" + name + "'";
        return statement.executeQuery(sql);
    }

    public Object byName(int n) throws SQLException {
        return statement.executeQuery("SELECT * FROM rows");
    }
}
""",
    "web/Names.java": """package web;

public class Names {
    static String plain(String name) {
        String out = name.trim();
        return out;
    }

    static String known(String name) {
        return "id";
    }
}
""",
    "web/Views.java": """package web;

public class Views {
    String row(String name) {
        String cell = cell(name);
        return cell;
    }

    String cell(String name) {
        return "<td>" + name + "</td>";
    }
}
""",
    "web/Store.java": """package web;

public class Store {
    byte[] open(String name) throws IOException {
        File f = new File("/data/" + name);
        return new FileInputStream(f).readAllBytes();
    }

    byte[] openChecked(String name) throws IOException {
        Path target = base.resolve(name).normalize();
        if (!target.startsWith(base)) throw new SecurityException();
        return new FileInputStream(new File(target.toString())).readAllBytes();
    }

    void execute(String command) throws IOException {
        Runtime.getRuntime().exec(command);
    }

    void executeListed(String command) throws IOException {
        if (!ALLOWED.contains(command)) throw new SecurityException();
        Runtime.getRuntime().exec(command);
    }

    void save(MultipartFile picture) throws IOException {
        picture.transferTo(box.resolve("picture"));
    }
}
""",
}

#: (type, file, line, function, last step of the chain that isn't told of a control)
PROJECT_EXPECTED: list[tuple[str, str, int, str, str]] = [
    ("COMMAND_INJECTION", "web/Front.java", 51, "run", "Store.execute"),
    ("DANGEROUS_FILE_UPLOAD", "web/Front.java", 59, "upload", "Store.save"),
    ("DANGEROUS_FILE_UPLOAD", "web/Store.java", 25, "save", "Store.save"),
    ("PATH_TRAVERSAL", "web/Front.java", 43, "file", "Store.open"),
    ("SQL_INJECTION", "web/Front.java", 15, "search", "FinderImpl.find > Rows.byName"),
    ("SQL_INJECTION", "web/Front.java", 24, "sorted", "FinderImpl.find > Rows.byName"),
    ("SQL_INJECTION", "web/Rows.java", 5, "byName", "Rows.byName"),
    ("XSS", "web/Front.java", 34, "page", "Views.row > Views.cell > Front.page"),
]

#: (class, variable, type) of fields and locals by which calls are resolved; a constructor's parameter gives store its type.
PROJECT_TYPES: list[tuple[str, str, str, str]] = [
    ("Front", "search", "finder", "Finder"),
    ("Front", "search", "q", "String"),
    ("Front", "search", "store", "Store"),
    ("Front", "search", "views", "Views"),
    ("Injected", "call", "inner", "Inner"),
    ("Injected", "call", "shadow", "Second"),
]

#: A field without a type of its own class gets the constructor parameter's; a local hides a field.
INJECTED = """class Injected extends Base {
    private List<First> shadow;
    Injected(Inner given) {
        this.inner = given;
    }
    void call() {
        Second[] shadow = null;
        inner.go(shadow);
    }
}
"""

#: One file, whose calls are told by name alone.
SINGLE = """class Single {
    void route(HttpServletRequest req) throws SQLException {
        String id = req.getParameter("id");
        load(id);
    }
    void routeFixed(HttpServletRequest req) throws SQLException {
        load("7");
    }
    void load(String id) throws SQLException {
        String sql = "SELECT * FROM t WHERE id = " + id;
        statement.executeQuery(sql);
    }
}
"""
SINGLE_EXPECTED: list[tuple[int, str, str]] = [(4, "route", "statement.executeQuery"), (10, "load", "statement.executeQuery")]
