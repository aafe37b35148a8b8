"""Hand-made page layouts with their article text. They were written to be scored, after the extractor and its training pages were settled."""

P1 = "The harbour was rebuilt in stone after the flood, and boats could moor there in winter."
P2 = "Two years later the market moved to the same quay."
P3 = "Fish, salt and timber were the main goods. Prices fell by a third."
A = f"<p>{P1}</p><p>{P2}</p><p>{P3}</p>"
T = "\n\n".join((P1, P2, P3))
NAV = '<ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/about">About us</a></li></ul>'

#: (name, html, text)
LAYOUTS = [
    ("blog, html5", f"<!doctype html><html><head><title>x</title></head><body><header><h1>My site</h1><nav>{NAV}</nav></header><main><article><h2>The quay</h2>{A}</article></main><footer><p>Copyright 2020.</p></footer></body></html>", "The quay\n\n" + T),
    ("blog, divs", f"<html><body><div id='header'><a href='/'>My site</a></div><div id='menu'>{NAV}</div><div id='content'><h1>The quay</h1>{A}</div><div id='footer'>All rights reserved.</div></body></html>", "The quay\n\n" + T),
    ("sidebar after", f"<body><div class='main-content'>{A}</div><div class='sidebar'><h3>Popular</h3>{NAV}</div></body>", T),
    ("sidebar before", f"<body><aside class='left-column'><h4>Archive</h4><p>Read older posts here.</p>{NAV}</aside><section class='post-body'>{A}</section></body>", T),
    ("advert in text", f"<body><article><p>{P1}</p><div class='ad-container'><p>Buy a boat today. Big savings.</p></div><p>{P2}</p></article></body>", f"{P1}\n\n{P2}"),
    ("cookie notice first", f"<body><div class='cookie-consent'><p>We use cookies to make this site work. Do you agree?</p><button>Yes</button></div><article>{A}</article></body>", T),
    ("newsletter form inside", f"<body><article><p>{P1}</p><form action='/sub'><h4>Stay informed</h4><p>Get our letter each week.</p><input type='email'><button>Join</button></form><p>{P3}</p></article></body>", f"{P1}\n\n{P3}"),
    ("comments below", f"<body><article>{A}</article><section id='comments'><h3>3 comments</h3><div class='comment'><b>Ann</b><p>I was there last year. It was cold.</p></div><div class='comment'><b>Bo</b><p>Nice story!</p></div></section></body>", T),
    ("comments as list", f"<body><main>{A}</main><ol class='comment-list'><li><p>First! This is great, thank you.</p></li><li><p>I do not agree with the prices.</p></li></ol></body>", T),
    ("list in the article", f"<body><article><p>{P1}</p><ul><li>Salt from the south.</li><li>Timber from the hills.</li></ul><p>{P2}</p></article></body>", f"{P1}\n\nSalt from the south.\n\nTimber from the hills.\n\n{P2}"),
    ("table in the article", f"<body><article><p>{P1}</p><table><tr><th>Good</th><th>Price</th></tr><tr><td>Salt</td><td>3</td></tr></table><p>{P2}</p></article></body>", f"{P1}\n\nGood\n\nPrice\n\nSalt\n\n3\n\n{P2}"),
    ("quotation", f"<body><article><p>{P1}</p><blockquote><p>We had never seen so many boats.</p></blockquote><p>{P2}</p></article></body>", f"{P1}\n\nWe had never seen so many boats.\n\n{P2}"),
    ("breadcrumbs and share buttons", f"<body><div class='breadcrumb'><a href='/'>Home</a> &gt; <a href='/h'>History</a></div><article><h1>The quay</h1>{A}<div class='share-bar'><a href='#'>Tweet</a> <a href='#'>Mail</a></div></article></body>", "The quay\n\n" + T),
    ("related links below", f"<body><article>{A}</article><div class='related-posts'><h3>More like this</h3>{NAV}</div></body>", T),
    ("line breaks for paragraphs", f"<body><div class='entry'>{P1}<br><br>{P2}</div><div class='footer'>Contact | Imprint</div></body>", f"{P1} {P2}"),
    ("no names at all", f"<body><div>{NAV}</div><div>{A}</div><div><a href='/i'>Imprint</a></div></body>", T),
    ("unclosed paragraphs", f"<body><nav>{NAV}</nav><article><p>{P1}<p>{P2}<p>{P3}</article>", T),
    ("links in the text", f"<body><nav>{NAV}</nav><article><p>The <a href='/h'>harbour</a> was rebuilt in <a href='/s'>stone</a> by the <em>guild</em>.</p><p>{P2}</p></article></body>", f"The harbour was rebuilt in stone by the guild.\n\n{P2}"),
    ("formula and button in the text", f"<body><article><p>The depth is <math><mi>d</mi><mo>=</mo><mn>4</mn></math> metres <button>copy</button> at low tide.</p><p>{P2}</p></article></body>", f"The depth is d=4 metres at low tide.\n\n{P2}"),
    ("figure with caption", f"<body><article><p>{P1}</p><figure><img src='q.jpg'><figcaption>The quay in 1902.</figcaption></figure><p>{P2}</p></article></body>", f"{P1}\n\nThe quay in 1902.\n\n{P2}"),
    ("header in the article", f"<body><article><header><h1>The quay</h1></header>{A}</article><footer>Imprint</footer></body>", "The quay\n\n" + T),
    ("nested wrappers", f"<body><div class='wrapper'><div class='row'><div class='col'><nav>{NAV}</nav></div><div class='col'><div><article>{A}</article></div></div></div></div></body>", T),
    ("definition list", f"<body><main><p>{P1}</p><dl><dt>Quay</dt><dd>A place to moor boats.</dd></dl></main></body>", f"{P1}\n\nQuay\n\nA place to moor boats."),
    ("login box and search", f"<body><form id='search'><input><button>Go</button></form><div class='login'><p>Sign in to continue.</p></div><article>{A}</article></body>", T),
    ("paywall notice at the end", f"<body><article><p>{P1}</p><p>{P2}</p><div class='paywall'><p>Subscribe to read more stories like this one.</p></div></article></body>", f"{P1}\n\n{P2}"),
    ("old table layout", f"<body><table><tr><td class='nav'>{NAV}</td><td class='content'>{A}</td></tr></table></body>", T),
    ("entities and white space", f"<body><article><p>Salt &amp; timber &lt;cheap&gt;\n\n  were&nbsp;sold &mdash; daily.</p><p>{P2}</p></article><footer>&copy; me</footer></body>", f"Salt & timber <cheap> were sold — daily.\n\n{P2}"),
    ("code block", f"<body><article><p>{P1}</p><pre>x = 1\ny = 2</pre><p>{P2}</p></article></body>", f"{P1}\n\nx = 1 y = 2\n\n{P2}"),
    ("tags and author box", f"<body><article>{A}</article><div class='tags'><a href='/t/1'>harbour</a> <a href='/t/2'>salt</a></div><div class='widget'><p>Follow us for more.</p></div></body>", T),
    ("menu only", f"<body><nav>{NAV}</nav><footer><p>Copyright.</p></footer></body>", ""),
]

#: A second set, written after training pages with articles in the body had been settled, and scored once.
MORE_LAYOUTS = [
    ("body: heading and paragraphs", f"<html><head><title>x</title></head><body><h1>The quay</h1>{A}</body></html>", "The quay\n\n" + T),
    ("body: paragraphs alone", f"<body>{A}", T),
    ("body: no tags for html or body", f"<title>x</title><h2>The quay</h2>{A}", "The quay\n\n" + T),
    ("body: bare text", f"<html><body>{P1}</body></html>", P1),
    ("body: breaks", f"<body>{P1}<br><br>{P2}<br><br>{P3}</body>", f"{P1} {P2} {P3}"),
    ("body: pre", f"<body><pre>{P1}\n{P2}</pre></body>", f"{P1} {P2}"),
    ("body: heading, breaks", f"<body><h1>The quay</h1>{P1}<br>{P2}</body>", f"The quay\n\n{P1} {P2}"),
    ("body: nav before", f"<body><nav>{NAV}</nav><h1>The quay</h1>{A}</body>", "The quay\n\n" + T),
    ("body: nav and footer", f"<body><nav>{NAV}</nav>{A}<footer><p>Copyright 2020.</p></footer></body>", T),
    ("body: menu in a div", f"<body><div class='menu'>{NAV}</div><h1>The quay</h1>{A}<div class='footer'>All rights reserved.</div></body>", "The quay\n\n" + T),
    ("body: header with site name", f"<body><header><h1>My site</h1></header>{A}</body>", T),
    ("body: sidebar", f"<body>{A}<aside><h3>Popular</h3>{NAV}</aside></body>", T),
    ("body: advert between", f"<body><p>{P1}</p><div class='advert'>Buy a boat today. Big savings.</div><p>{P2}</p></body>", f"{P1}\n\n{P2}"),
    ("body: cookie notice", f"<body><div id='cookie-notice'><p>We use cookies on this site.</p><button>Yes</button></div><h1>The quay</h1>{A}</body>", "The quay\n\n" + T),
    ("body: comments", f"<body><h1>The quay</h1>{A}<div class='comments'><h3>2 comments</h3><div><b>Ann</b><p>I was there last year. It was cold.</p></div></div></body>", "The quay\n\n" + T),
    ("body: list in the text", f"<body><p>{P1}</p><ul><li>Salt from the south.</li><li>Timber from the hills.</li></ul><p>{P2}</p></body>", f"{P1}\n\nSalt from the south.\n\nTimber from the hills.\n\n{P2}"),
    ("body: sections with headings", f"<body><h1>The quay</h1><h2>Before</h2><p>{P1}</p><h2>After</h2><p>{P2}</p></body>", f"The quay\n\nBefore\n\n{P1}\n\nAfter\n\n{P2}"),
    ("body: quotation", f"<body><p>{P1}</p><blockquote>We had never seen so many boats.</blockquote><p>{P2}</p></body>", f"{P1}\n\nWe had never seen so many boats.\n\n{P2}"),
    ("body: share buttons", f"<body><h1>The quay</h1>{A}<div class='share'><a href='#'>Tweet</a> <a href='#'>Mail</a></div></body>", "The quay\n\n" + T),
    ("body: search form", f"<body><form><input><button>Go</button></form><h1>The quay</h1>{A}</body>", "The quay\n\n" + T),
    ("div: breaks and share", f"<body><div class=post>{P1}<br><br>{P2}<div class=share><a href=x>Tweet</a></div></div></body>", f"{P1} {P2}"),
    ("div: unnamed, breaks, menu", f"<body><div>{NAV}</div><div>{P1}<br><br>{P2}</div></body>", f"{P1} {P2}"),
    ("table: unnamed, menu left", f"<body><table><tr><td><a href='/'>Home</a><br><a href='/n'>News</a></td><td>{A}</td></tr></table></body>", T),
    ("table: unnamed, menu list", f"<body><table width='100%'><tr><td>{NAV}</td><td><h1>The quay</h1>{A}</td></tr></table></body>", "The quay\n\n" + T),
    ("table: menu right", f"<body><table><tr><td>{A}</td><td>{NAV}</td></tr></table></body>", T),
    ("table: banner row", f"<body><table><tr><td>My site</td></tr><tr><td>{NAV}</td><td>{A}</td></tr></table></body>", T),
    ("table: breaks in the cell", f"<body><table><tr><td>{NAV}</td><td>{P1}<br><br>{P2}</td></tr></table></body>", f"{P1} {P2}"),
    ("article in section", f"<body><section><h1>The quay</h1>{A}</section><section class='related'><h3>More</h3>{NAV}</section></body>", "The quay\n\n" + T),
    ("main with ids", f"<body><div id='page'><div id='nav'>{NAV}</div><main id='main'><h1>The quay</h1>{A}</main></div></body>", "The quay\n\n" + T),
    ("two columns, no names", f"<body><div><div>{NAV}</div><div><h1>The quay</h1>{A}</div></div></body>", "The quay\n\n" + T),
    ("newsletter below", f"<body><article>{A}</article><div class='newsletter'><p>Get our letter each week.</p></div></body>", T),
    ("popup", f"<body><div class='modal'><p>Sign up now and save.</p></div><div class='content'>{A}</div></body>", T),
    ("footer links", f"<body><article>{A}</article><footer>{NAV}</footer></body>", T),
    ("pager", f"<body><article>{A}</article><div class='pager'><a href='/2'>Next</a></div></body>", T),
    ("masthead", f"<body><div class='masthead'>My site <a href='/'>Home</a></div><div class='story'>{A}</div></body>", T),
    ("nested lists", f"<body><article><p>{P1}</p><ol><li>One way leads south.<ul><li>It is the shorter one.</li></ul></li></ol></article></body>", f"{P1}\n\nOne way leads south.\n\nIt is the shorter one."),
    ("reader comments as articles", f"<body><article>{A}</article><div id='comments'><article class='comment'><p>Nice story, thank you!</p></article></div></body>", T),
    ("details in the text", f"<body><article><p>{P1}</p><details><summary>More on this</summary><p>{P2}</p></details></article></body>", f"{P1}\n\nMore on this\n\n{P2}"),
    ("empty body", "<html><head><title>x</title></head><body></body></html>", ""),
    ("menus only", f"<body><nav>{NAV}</nav><div class='menu'>{NAV}</div></body>", ""),
]
