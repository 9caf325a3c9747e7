"""Twelve pages written by hand, each of another make, none of it from the practice pages: (html, lines of main text)."""

A = "The ferry to the outer islands will run again from Monday, the harbour office said on Friday."
B = "Repairs took three weeks longer than planned because a part had to be cast anew in Gdansk."
C = "Islanders, who had relied on fishing boats for their mail and medicine, welcomed the news."
D = "\"We baked every loaf ourselves,\" said Marta Lind, who keeps the only shop."
E = "Fares stay as they were. Children under six travel free."
F = "Old bridges of the upper valley"
G = "Nobody knows who laid the first stones. Parish books of 1412 speak of a toll, and a flood that took the keeper and his dog."
H = "The arches are narrow; two carts could not pass. In dry summers you can still read the masons' marks under the second span."
J = "How to keep a sourdough alive"
K = "Feed it once a day with equal weights of flour and water. If it smells of acetone it is hungry."
L = "Cold slows it down, so a jar in the fridge needs food only once a week."
M = "Before baking, take it out the evening before and feed it twice."

PAGES = [
    # nested boxes with meaningless names
    (
        f"<html><head><title>Ferry back on Monday</title></head><body><div class=c1><div class=c2><div class=c3><a href=/>Harbour Post</a> <a href=/n>News</a> <a href=/w>Weather</a></div></div>"
        f"<div class=c4><div class=c5><div class=c6><h2>Ferry back on Monday</h2></div><div class=c7><p>{A}</p><p>{B}</p><p>{C}</p></div></div></div><div class=c8><p>Copyright 2019 Harbour Post. All rights reserved.</p></div></div></body></html>",
        ["Ferry back on Monday", A, B, C],
    ),
    # a table layout with fonts and double line breaks
    (
        f"<HTML><HEAD><TITLE>{F}</TITLE></HEAD><BODY BGCOLOR=white><CENTER><FONT SIZE=1>This site uses cookies. OK</FONT></CENTER><TABLE WIDTH=100%><TR><TD WIDTH=20%><FONT SIZE=2><A HREF=a.htm>Start</A><BR><A HREF=b.htm>Maps</A><BR><A HREF=c.htm>Guestbook</A></FONT></TD>"
        f"<TD><FONT SIZE=5><B>{F}</B></FONT><BR><BR>{G}<BR><BR>{H}<BR><BR>{L}</TD></TR></TABLE><HR><FONT SIZE=1>Last changed in 2003. Webmaster: Jo. Best viewed in 800x600.</FONT></BODY></HTML>",
        [F, G, H, L],
    ),
    # bare boxes as paragraphs
    (
        f'<html><head><title>{J} | Crumb</title></head><body><div class="story-wrapper"><div class="hd">{J}</div><div>{K}</div><div>{L}</div><div>{M}</div></div><div class="promo-strip">Advertisement<div>Bread knives, now half price. Buy now</div></div>'
        "<div class='bottom-bar'><a href=/t>Terms</a><a href=/p>Privacy</a></div></body></html>",
        [J, K, L, M],
    ),
    # a weblog with a list of comments
    (
        f"<html><head><title>{J}</title></head><body><div id=hdr><span>Tante Olga's oven</span></div><ul id=tabs><li><a href=/>Home</a></li><li><a href=/about>About me</a></li></ul><div class=entry-9><h1>{J}</h1><p>{K}</p><p>{L}</p><p>{M}</p></div>"
        "<div id=talk><h3>4 comments</h3><ol><li><b>Pia</b> says: <p>Mine died in the heat last summer, I cried a bit.</p><a href=#>Reply</a></li><li><b>Tom K.</b> says: <p>Rye works better than wheat in my kitchen, try it.</p><a href=#>Reply</a></li></ol>"
        "<form><label>Your comment</label><textarea></textarea><button>Send</button></form></div><div id=ftr>Powered by WordPress</div></body></html>",
        [J, K, L, M],
    ),
    # HTML5 elements, an aside inside the article
    (
        f"<!doctype html><html><head><title>Ferry back on Monday - Harbour Post</title></head><body><header><h1>Harbour Post</h1><nav><a href=/>Front page</a><a href=/sea>At sea</a></nav></header><main><section><h2>Ferry back on Monday</h2><p>{A}</p><aside><h4>Read also</h4><ul><li><a href=/1>Herring quota cut again</a></li><li><a href=/2>Lighthouse for sale</a></li></ul></aside><p>{B}</p><p>{D}</p><p>{E}</p></section></main>"
        "<footer><p>Harbour Post, Quay 7. Editor: R. Holm.</p></footer></body></html>",
        ["Ferry back on Monday", A, B, D, E],
    ),
    # utility classes of a generated site
    (
        f'<html><head><title>{F}</title></head><body><div id="__next"><div class="flex px-4 sc-a1b"><div class="w-8"><a href="/">Valley</a></div><div><a href="/walks">Walks</a><a href="/huts">Huts</a><a href="/login">Log in</a></div></div>'
        f'<div class="mx-auto sc-x9"><div class="text-4xl">{F}</div><div class="mt-4"><span>{G}</span></div><div class="mt-4"><span>{H}</span></div></div><div class="grid gap-2"><div>You may also like</div><a href="/a">Ten huts for rainy days</a><a href="/b">A walk to the glacier</a></div><div class="text-xs">© 2024 Valley Tourism. Privacy · Imprint</div></div></body></html>',
        [F, G, H],
    ),
    # no closing tags at all, a list in the text
    (
        f"<title>{J}</title><p><a href=/>Kitchen</a> | <a href=/r>Recipes</a> | <a href=/s>Search</a><h1>{J}</h1><p>{K}<p>You need:<ul><li>flour, any kind<li>water<li>a jar with a loose lid</ul><p>{L}<p>{M}<hr><p>Copyright Kitchen. Contact us",
        [J, K, "You need:", "flour, any kind", "water", "a jar with a loose lid", L, M],
    ),
    # a page in one form, as some servers make them
    (
        f'<html><head><title>Notice of works</title></head><body><form id="aspnetForm"><table><tr><td><a href="1">Residents</a></td><td><a href="2">Business</a></td><td><a href="3">Council</a></td></tr></table><div id="ctl00_phl"><h3>Ferry terminal works</h3><p>{A}</p><p>{B}</p><p>{E}</p></div><div id="ctl00_ft">© Borough Council | <a href=x>Accessibility</a></div></form></body></html>',
        ["Ferry terminal works", A, B, E],
    ),
    # a newsletter box, share links and a pager around
    (
        f"<html><head><title>{F}</title></head><body><section class=zq1><p>We value your privacy. Accept cookies to continue.</p><button>Accept</button></section><section class=zq2><h1>{F}</h1><ul><li><a href=#>Facebook</a></li><li><a href=#>Email this</a></li></ul><p>{G}</p><section class=zq3><p>Subscribe to our newsletter</p><input><button>Sign up</button></section><p>{H}</p><p>{L}</p></section>"
        "<section class=zq4><a href=/1>Previous article</a><a href=/2>Next article</a></section><section class=zq5><p>Terms of use. Privacy policy.</p></section></body></html>",
        [F, G, H, L],
    ),
    # Spanish, with a quote and an embedded object
    (
        "<html><head><title>El pan de la abuela</title></head><body><div class=cab><a href=/>Inicio</a> <a href=/r>Recetas</a> <a href=/c>Contacto</a></div><div class=nota><h1>El pan de la abuela</h1><p>En el pueblo todavía se amasa los viernes, como hace cien años, y el horno se enciende antes del alba.</p><blockquote><p>«Sin prisa sale mejor», repite Carmen mientras pesa la harina.</p></blockquote><object data=v><p>Las hogazas reposan bajo un paño de lino hasta que doblan su tamaño.</p></object><p>Después se reparten entre los vecinos.</p></div><div class=pie>Todos los derechos reservados.</div></body></html>",
        ["El pan de la abuela", "En el pueblo todavía se amasa los viernes, como hace cien años, y el horno se enciende antes del alba.", "«Sin prisa sale mejor», repite Carmen mientras pesa la harina.", "Las hogazas reposan bajo un paño de lino hasta que doblan su tamaño.", "Después se reparten entre los vecinos."],
    ),
    # definition lists as a menu, text in sections, a disclosure of comments
    (
        f"<html><head><title>Ferry back on Monday</title></head><body><dl><dt>Sections<dd><a href=/l>Local</a><dd><a href=/s>Sport</a></dl><div><div><h2>Ferry back on Monday</h2><div><p>{A}</p><p>{C}</p><p>{D}</p><p>{E}</p></div></div></div><details><summary>Reader comments</summary><div><strong>oldsalt</strong> 2 hours ago<p>About time, the old boat was a shame for the whole county.</p><span>Like</span> <span>Reply</span></div></details></body></html>",
        ["Ferry back on Monday", A, C, D, E],
    ),
    # math, code and a table of figures in the text; a script notice
    (
        f"<html><head><title>Counting arches</title></head><body><noscript>Please enable JavaScript to view this page.</noscript><div class=wr><h1>Counting arches</h1><p>If a bridge has <math><mi>n</mi></math> piers it has <code>n + 1</code> arches, unless it is a ruin.</p><table><tr><th>Bridge</th><th>Arches</th></tr><tr><td>Upper mill</td><td>3</td></tr></table><p>{H}</p><p>{G}</p></div><div class=zz>Sponsored: stone cutters near you. Get a quote</div></body></html>",
        ["Counting arches", "If a bridge has n piers it has n + 1 arches, unless it is a ruin.", "Bridge", "Arches", "Upper mill", "3", H, G],
    ),
]

#: Written after the model was settled, and looked at once.
FRESH = [
    (
        f"<html><head><title>Quay &amp; Crane: {F}</title></head><body><div class=qx0><img src=l.png> Quay &amp; Crane <a href=/1>Ships</a> <a href=/2>Crews</a></div><div class=qx1><div class=qx2><h1>{F}</h1><div>{G}</div><div>{H}</div><div>{A}</div><div>{B}</div></div><div class=qx3><div>Popular posts</div><div><a href=/4>The last tug of the line</a></div><div><a href=/5>Night watch on the pier</a></div></div></div></body></html>",
        [F, G, H, A, B],
    ),
    (
        f"<html><head><title>{J}</title></head><body><p><a href=i.html>Up</a> <a href=n.html>Next</a></p><h2>{J}</h2><p>{L}</p><p>{M}</p><blockquote>{K}</blockquote><p>{E}</p><address>Maintained by the baking club. Copyright 2001.</address></body></html>",
        [J, L, M, K, E],
    ),
    (
        f"<html><head><title>Ferry news</title></head><body><table><tr><td colspan=3>Island Echo<tr><td><a href=a>Front</a><br><a href=b>Letters</a><td><font size=4>Ferry news</font><p>{A}<p>{C}<p>{D}<td>Advertisement<br><a href=c>Rent a boat for the weekend</a></table></body></html>",
        ["Ferry news", A, C, D],
    ),
    (
        f"<html><head><title>{F}</title></head><body><section><nav><ol><li><a href=/>Valley</a><li><a href=/b>Bridges</a></ol></nav><h1>{F}</h1><p>{H}</p><figure><img src=b.jpg><figcaption>The second span in August.</figcaption></figure><p>{G}</p><p>{B}</p></section><section><h3>Responses</h3><div><b>mason77</b> wrote:<p>My grandfather cut two of those marks.</p><a href=#>Reply</a></div></section><footer>Valley Walks 2020</footer></body></html>",
        [F, H, "The second span in August.", G, B],
    ),
]
