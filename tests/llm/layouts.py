"""Page layouts written by hand: (name, page, the text that belongs to the article)."""

A = "The river had risen all week, and by Friday the lower road was under water. Nobody in the village had seen it so high."
B = "Farmers moved their animals to the upper fields, while the school opened its hall for those who could not go home."
C = "Engineers said that the old dam would hold, though they kept watching it through the night, measuring every hour."
D = "By Sunday the rain had stopped, the water fell slowly, and people began to count what they had lost."
T = "A long week by the river"
MENU = "<ul><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li><li><a href=/c>Culture</a></li><li><a href=/w>Weather</a></li></ul>"
SHARE = "<a href=/f>Share</a> <a href=/t>Post</a> <a href=/m>Mail</a>"
RELATED = "<h3>More stories</h3><ul><li><a href=/1>Bridge closed for repairs</a></li><li><a href=/2>New mayor elected</a></li><li><a href=/3>Harvest festival returns</a></li></ul>"
COMMENTS = "<div><b>Tom</b><p>I was there, it was terrible.</p></div><div><b>Eve</b><p>Thanks to all the helpers!</p></div>"
TAIL = "<p>Copyright 2024 The Valley Paper. All rights reserved.</p><p><a href=/i>Imprint</a> <a href=/p>Privacy</a> <a href=/k>Contact</a></p>"

ps = lambda *x: "".join(f"<p>{t}</p>" for t in x)
joined = lambda *x: " ".join(x)

LAYOUTS = [
    ("plain article", f"<html><head><title>{T}</title></head><body><nav>{MENU}</nav><article><h1>{T}</h1>{ps(A, B, C, D)}</article><footer>{TAIL}</footer></body></html>", joined(T, A, B, C, D)),
    ("own header with title", f"<body><header><div>The Valley Paper</div>{MENU}</header><main><article><header><h1>{T}</h1></header>{ps(A, B)}<h2>The dam</h2>{ps(C, D)}</article></main><footer>{TAIL}</footer>", joined(T, A, B, "The dam", C, D)),
    ("classes only", f'<body><div class="site-header"><a href=/>The Valley Paper</a></div><div class="navbar">{MENU}</div><div class="post"><h1>{T}</h1>{ps(A, B, C, D)}</div><div class="sidebar">{RELATED}</div><div class="footer">{TAIL}</div>', joined(T, A, B, C, D)),
    ("ids only", f'<body><div id="masthead"><p>The Valley Paper</p></div><div id="menu">{MENU}</div><div id="content"><h1>{T}</h1>{ps(A, B, C, D)}</div><div id="comments"><h3>2 comments</h3>{COMMENTS}</div><div id="footer">{TAIL}</div>', joined(T, A, B, C, D)),
    ("reader comments inside", f'<body><nav>{MENU}</nav><article><h1>{T}</h1>{ps(A, B, C, D)}<section class="comments"><h3>Comments</h3>{COMMENTS}</section></article><footer>{TAIL}</footer>', joined(T, A, B, C, D)),
    ("notice and form inside", f'<body><main><h1>{T}</h1>{ps(A, B)}<div class="newsletter"><p>Get our best stories every morning, free of charge.</p><form action=/s><input name=e><button>Sign up</button></form></div>{ps(C, D)}</main><aside>{RELATED}</aside><footer>{TAIL}</footer>', joined(T, A, B, C, D)),
    ("cookie notice first", f'<body><div class="cookie-banner"><p>We use cookies to improve this site, and share data with partners.</p><button>OK</button></div><nav>{MENU}</nav><article><h1>{T}</h1>{ps(A, B, C, D)}</article><footer>{TAIL}</footer>', joined(T, A, B, C, D)),
    ("wrapped deep", f'<body><div class="wrap"><div class="row"><div class="col"><nav>{MENU}</nav></div><div class="col"><div class="entry"><div class="entry-content"><h1>{T}</h1>{ps(A, B, C, D)}</div></div></div></div></div><footer>{TAIL}</footer>', joined(T, A, B, C, D)),
    ("lists and quotes", f"<body><nav>{MENU}</nav><article><h1>{T}</h1><p>{A}</p><ul><li>{B}</li><li>{C}</li></ul><blockquote><p>{D}</p></blockquote></article><footer>{TAIL}</footer>", joined(T, A, B, C, D)),
    ("share links inside", f'<body><nav>{MENU}</nav><article><h1>{T}</h1><div class="share">{SHARE}</div>{ps(A, B, C, D)}<div class="related">{RELATED}</div></article><footer>{TAIL}</footer>', joined(T, A, B, C, D)),
    ("advert between", f'<body><nav>{MENU}</nav><article><h1>{T}</h1>{ps(A, B)}<div class="ad">Buy two pairs of boots and pay for one only.</div>{ps(C, D)}</article><footer>{TAIL}</footer>', joined(T, A, B, C, D)),
    ("table", f"<body><nav>{MENU}</nav><article><h1>{T}</h1><p>{A}</p><table><tr><th>Day</th><th>Level</th></tr><tr><td>Monday</td><td>2.1 m</td></tr></table>{ps(B, C, D)}</article><footer>{TAIL}</footer>", joined(T, A, "Day Level Monday 2.1 m", B, C, D)),
    ("no telling names", f"<body><div>{MENU}</div><div><h1>{T}</h1>{ps(A, B, C, D)}</div><div>{TAIL}</div>", joined(T, A, B, C, D)),
    ("no telling names, column beside", f"<body><table><tr><td>{MENU}</td><td><h1>{T}</h1>{ps(A, B, C, D)}</td><td>{RELATED}</td></tr></table><div>{TAIL}</div>", joined(T, A, B, C, D)),
    ("no telling names, newsletter column", f"<body><div>{MENU}</div><div><div><h1>{T}</h1>{ps(A, B, C, D)}</div><div><h3>Newsletter</h3><p>Get our best stories by mail every morning.</p><form><input name=e><button>Go</button></form></div></div><div>{TAIL}</div>", joined(T, A, B, C, D)),
    ("short article", f'<body><nav>{MENU}</nav><article><h1>{T}</h1><p>{A}</p></article><aside>{RELATED}<p>{B}</p></aside><footer>{TAIL}</footer>', joined(T, A)),
    ("old tags, unclosed", f"<body><center>{MENU}</center><div class=story><h2>{T}</h2><p>{A}<p>{B}<p>{C}<p>{D}</div><hr><center>{TAIL}</center>", joined(T, A, B, C, D)),
    ("spans and breaks", f'<body><nav>{MENU}</nav><div class="article-body"><h1>{T}</h1><span class="lead">{A}</span><br><br>{B}<br><br>{C}<br>{D}</div><div class="footer">{TAIL}</div>', joined(T, A, B, C, D)),
]
